import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parents[1]), str(pathlib.Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from rostrum.session import local_session
    s = local_session("4", "6g", "rostrum-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
