import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rostrum.llm import importance

DOC = "doc_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs_of(text, runs):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def expected(docs, target, percent=10, least=20, runs=1, buckets=10_000, seed=2024):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(h % buckets for h in runs_of(text, runs))
    for text in target:
        t.update(h % buckets for h in runs_of(text, runs))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in {*s, *t}}
    rows = []
    for i, text in docs:
        f = [h % buckets for h in runs_of(text, runs)]
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def result(spark, docs, target, **kw):
    got = importance.resample(spark.createDataFrame(docs, DOC), spark.createDataFrame([(x,) for x in target], "text string"), **kw)
    return sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def some(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gämma", "x" * 60, "é" * 40, "42", "d-e", "zeta"] + [f"w{i}" for i in range(60)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("runs,percent", [(1, 10), (3, 35)])
def test_same_as_one_by_one(spark, runs, percent):
    docs = [*enumerate(some(300)), (-5, None), (None, "word " * 25), (900, "long " * 30_000), (901, "")]
    target = [*some(20, 9), None, ""]
    assert result(spark, docs, target, runs=runs, percent=percent, buckets=500) == expected(docs, target, percent, 20, runs, 500)


def test_hash_of_any_word_length():
    data = np.frombuffer("é".encode() * 300 + b"abc", np.uint8)
    start, stop = np.array([0, 0, 600, 5, 603]), np.array([603, 47, 603, 54, 603])
    got = importance.checksum(np.zeros(5, np.uint32), data, start, stop)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, stop)]


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, 7) for i in range(1000, 0, -3)] + [(5_000_000_000 + i, 8) for i in range(4)] + [(None, 7)] * 2, "doc_id long, score long")
    n = scored.count()
    for wanted in (0, 1, 3, 4, 5, 200, n - 3, n - 1, n):
        got = importance.ranked(scored.where(importance.draw(scored, wanted)), wanted).where("rank is not null").collect()
        want = sorted(((r["score"], r["doc_id"]) for r in scored.collect()), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:wanted]
        assert [(r["score"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in got) == list(range(1, wanted + 1))


def test_repeated_rows_at_the_cutoff(spark):
    scored = spark.createDataFrame([(1, 9), (2, 5), (2, 5), (2, 5), (3, 5)], "doc_id long, score long")
    got = importance.ranked(scored.where(importance.draw(scored, 3)), 3).collect()
    assert sorted((r["doc_id"], r["rank"]) for r in got if r["rank"]) == [(1, 1), (2, 2), (2, 3)] and len(got) == 4


def test_empty_tables_and_other_columns(spark):
    assert result(spark, [], ["a b"]) == []
    docs = [(i, "one two three " * 9) for i in range(30)]
    assert result(spark, docs, []) == expected(docs, [])
    frame = spark.createDataFrame([(1, "a", 2, 3.0)], DOC + ", score int, _at double")
    assert [r["rank"] for r in importance.resample(frame, frame).collect()] == [None]
