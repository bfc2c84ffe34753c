"""The other queries work where the training-data folders are gone."""
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
assert e.__file__.startswith({root!r})
print(len(e.queries()), any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in [*e.queries(), *e.oracle_sql()]))
"""


def _copy(tmp_path, *without):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if "pipeline" not in without:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    shutil.copytree(ROOT / "rostrum", tmp_path / "rostrum", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if "llm" in without else [])))
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(tmp_path))], capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert out.returncode == 0, out.stderr[-800:]
    return out.stdout.split()


def test_both_folders_and_the_pipeline_gone(tmp_path):
    n, named = _copy(tmp_path, "llm", "pipeline")
    assert int(n) > 50 and named == "False"


def test_only_the_package_gone(tmp_path):
    assert _copy(tmp_path, "llm")[1] == "False"
