import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def topic(text):
    for name, mark in (("contact", "@"), ("table", " | "), ("licence", "icense"), ("symbols", "### ")):
        if mark in text:
            return name
    return "short" if len(text) < 400 else "prose"


def brute(rows, targets, rate):
    """The same fit with dictionaries."""
    cells = defaultdict(float)
    for _, text, lang, source in rows:
        cells[(source or "(none)", lang or "(none)", topic(text or ""))] += len(WORD.findall(text or ""))
    total, want = sum(cells.values()), []
    for d, dim in enumerate(mixing.DIMS):
        sums = defaultdict(float)
        for c, t in cells.items():
            sums[c[d]] += t
        sums = {k: t for k, t in sums.items() if t}
        listed = targets.get(dim, {})
        left, free = 1 - sum(listed.values()), sum(t for k, t in sums.items() if k not in listed)
        share = {k: listed[k] if k in listed else left * t / free for k, t in sums.items()}
        want.append({k: v / sum(share.values()) * total for k, v in share.items()})
    w = dict(cells)
    for _ in range(2000):
        for d in range(3):
            sums = defaultdict(float)
            for c, x in w.items():
                sums[c[d]] += x
            w = {c: x * want[d][c[d]] / sums[c[d]] if x else 0 for c, x in w.items()}
    ratio = {c: w[c] / t if t else 1.0 for c, t in cells.items()}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(t * min(1, mid * ratio[c]) for c, t in cells.items()) < rate * total else (lo, mid)
    return {c: min(1, hi * r) for c, r in ratio.items()}, want, w


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(3), []
    for i in range(1500):
        text = " ".join(["word"] * int(rng.integers(1, 200))) + ["", " a@b.c", " x | y", " License", " ### z"][rng.integers(0, 5)]
        out.append((i, text, ["en", "de", "fr", None][min(3, rng.integers(0, 6))], f"s{min(4, rng.integers(0, 9))}"))
    return out + [(None, None, None, None), (None, "", "en", "s0"), (5, "five", "en", "s1"), (5, "five", "en", "s1"), (9_999, "w " * 50_000, "de", "s9")]


@pytest.mark.parametrize("targets,rate", [({}, 0.3), ({"source": {"s0": 0.4, "gone": 0.1}, "lang": {"en": 0.2, "de": 0.5}, "topic": {"prose": 0.1}}, 0.5)])
def test_same_as_brute_force(spark, rows, targets, rate):
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, lang string, source string, topic string").repartition(5)
    got = mixing.sample(docs, targets, rate).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*docs.columns, "probability", "sampled"}
    want, _, _ = brute(rows, targets, rate)
    for r in got:
        assert abs(r.probability - want[(r.source or "(none)", r.lang or "(none)", topic(r.text or ""))]) < 1e-4, r
    assert len({r.sampled for r in got if r.doc_id == 5}) == 1
    kept = sum(len(WORD.findall(r.text or "")) for r in got if r.sampled and r.doc_id != 9_999)
    hoped = sum(len(WORD.findall(r.text or "")) * r.probability for r in got if r.doc_id != 9_999)
    assert abs(kept - hoped) < 0.1 * hoped
    again = mixing.sample(docs.repartition(2), targets, rate).where("sampled").select("doc_id").collect()
    assert sorted(r.doc_id for r in again if r.doc_id is not None) == sorted(r.doc_id for r in got if r.sampled and r.doc_id is not None)


def test_marginals_are_met(spark, rows):
    docs = spark.createDataFrame(rows[:1500], "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.4}, "lang": {"en": 0.2, "de": 0.5}, "topic": {"prose": 0.1}}
    raked = mixing.rake(mixing.cells_of(docs), targets).toPandas()
    _, want, _ = brute(rows[:1500], targets, 0.5)
    for d, dim in enumerate(mixing.DIMS):
        for value, x in raked.groupby(dim)["weight"].sum().items():
            assert abs(x - want[d][value]) <= 1e-5 * want[d][value]


def test_many_cells_take_the_shuffle(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    a = {(r.doc_id, r.text, r.sampled) for r in mixing.sample(docs, {"lang": {"en": 0.1}}, 0.4).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert a == {(r.doc_id, r.text, r.sampled) for r in mixing.sample(docs, {"lang": {"en": 0.1}}, 0.4).collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", "de", "s")], "doc_id long, text string, lang string, source string")
    assert mixing.sample(docs.where("false"), {}, 0.5).count() == 0
    assert {r.probability for r in mixing.sample(docs, {"lang": {"en": 0.5, "de": 0.5}}, 1.0).collect()} == {1.0}
    only = {r.doc_id: r.probability for r in mixing.sample(docs, {"lang": {"en": 1.0}}, 0.9).collect()}
    assert only == {1: 1.0, 2: 0.0}
    own = mixing.sample(docs, {"topic": {"x": 0.5}}, 1.0, F.lit("x"))
    assert {r.topic for r in own.collect()} == {"x"}


def test_columns_with_the_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1, 2, 3, 4, 5, "x.y"), (2, "c", "de", "s", 1, 2, 3, 4, 5, "z")],
                                 "doc_id long, text string, lang string, source string, _p int, _cell int, row int, cell int, salt int, `a.b` string")
    got = mixing.sample(docs, {"lang": {"en": 0.5, "de": 0.5}}, 1.0)
    assert got.columns == [*docs.columns, "topic", "probability", "sampled"]
    assert sorted(tuple(r)[:10] for r in got.collect()) == sorted(tuple(r) for r in docs.collect())
