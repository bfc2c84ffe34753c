import re

import pytest

from rostrum.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    wins = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[i:i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for win, ids in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    items |= {str(x) for x in ids if x is not None}
        out.append((doc, len(w), len(hit), sorted(items)))
    return out


LONG = " ".join(f"w{i}" for i in range(40))
BENCH = [(1, LONG), (2, "Two words"), (3, "one"), (4, None), (5, "..."), (None, "nothing known here"), (7, LONG.upper()), (7, "über den Fluß")]
DOCS = [(1, "x " + LONG + " y"), (2, None), (3, ""), (4, "two, WORDS two words"), (5, "One one x"), (6, " ".join(f"w{i}" for i in range(12))),
        (7, " ".join(f"w{i}" for i in range(5, 19))), (8, "see nothing known here"), (None, "two words"), (9, "ÜBER den Fluß über den fluß über den Fluß"),
        (9, "ÜBER den Fluß über den fluß über den Fluß"), (10, " ".join(["w1 w2 w3"] * 3000) + " " + LONG)]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_same_as_brute_force(spark, block):
    docs = spark.createDataFrame([(d, t, "n", 1.0) for d, t in DOCS], "doc_id long, text string, items string, n_words double")
    bench = spark.createDataFrame([(i, t, 0) for i, t in BENCH], "item_id long, text string, doc_id int")
    got = decontaminate.find_matches(docs, bench, block_bytes=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=key) == sorted(brute(DOCS, BENCH), key=key)
    longest = {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in got}
    assert longest[1] == (40, 1, "1") and longest[7] == (14, 0, "1") and longest[2] == (0, None, None)
    kept = decontaminate.remove_contaminated(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns
    clean = [d for d, n, h, _ in brute(DOCS, BENCH) if not (h and 20 * h >= n)]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert {r.n_hit for r in decontaminate.find_matches(docs, bench.where("false")).collect()} == {0}
    assert decontaminate.find_matches(docs.where("false"), bench).count() == 0
