import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import jaccard
from rostrum.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return out


def texts(seed, groups, copies, n):
    """Groups of chains: each copy changes a few words of an earlier one."""
    rng, out = random.Random(seed), []
    boiler = " ".join(f"legal{i}" for i in range(30))
    for _ in range(groups):
        family = [[f"v{rng.randrange(400)}" for _ in range(rng.randint(6, n))]]
        for _ in range(rng.randint(0, copies)):
            w = list(rng.choice(family))
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(400)}"
            family.append(w if rng.random() < 0.8 else w[:-rng.randint(1, 3)] or w)
        out += [" ".join(w) + (" " + boiler if rng.random() < 0.4 else "") for w in family]
    rng.shuffle(out)
    return out


EDGE = [None, "", " \n\t", "one", "ONE", "one two", "one two three four", "one two three four", "One two three four five", "a b c d e f", "a b c d e f",
        " ".join(f"x{i}" for i in range(30_000)), " ".join(f"x{i}" for i in range(29_000)), "same " * 50, "same " * 7]


@pytest.mark.parametrize("seed,tile,sample", [(1, 2048, 4096), (2, 3, 1), (3, 8, 200)])
def test_same_as_brute_force(spark, monkeypatch, seed, tile, sample):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "LEAF", 4 if tile < 100 else 32)
    body = texts(seed, 25, 12, 120) + EDGE
    rows = [(i * 3 + 1, t) for i, t in enumerate(body)] + [(None, body[0]), (4, body[1]), (4, body[1]), (None, "lonely text without an id at all"), (2, body[5])]
    docs = spark.createDataFrame([(*r, "k", 9) for r in rows], "doc_id long, text string, cls string, n int").repartition(3)
    got = [tuple(r) for r in jaccard.link(docs, sample=sample).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_group_of_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(80)] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.link(docs).collect()), key=str) == sorted(brute(rows), key=str)


def test_few_rows_make_few_tasks(spark, monkeypatch):
    """With many partitions that adaptive execution leaves apart, tables of a few
    hundred rows are still written by a few tasks."""
    rows = [(i, t) for i, t in enumerate(texts(7, 60, 8, 60))]
    files, write = [], jaccard.shared_table

    def shared_table(df):
        out = write(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard, "shared_table", shared_table)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(brute(rows))
    # All but the members of blocks, whose number nobody knows before.
    assert sum(n > 12 for n in files) <= 1, files


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").where("false")
    assert jaccard.link(docs).count() == 0


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 64, 900, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 600))) for _ in range(60)]
    tree = jaccard.Tree(np.array([len(s) for s in sets]), [jaccard.point(s) for s in sets])
    p, q = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    overlap = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(p, q)])
    assert (jaccard._fine(tree, tree, p, q) >= overlap).all()
    for point in (np.arange(16), np.arange(16) * 15, np.arange(16) * 1000, np.ones(256, int)):
        assert (jaccard.unpack_point(jaccard.pack_point(point)) == point).all()
    for percent in (30, 60, 75):
        found = {tuple(sorted(map(int, x))) for a, b, _ in jaccard.candidate_pairs(tree, tree, percent) for x in zip(a, b)}
        linked = {(int(i), int(j)) for i, j, o in zip(p, q, overlap) if i < j and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o)}
        assert linked <= found


def test_components_of_a_long_chain(spark):
    n = 2000
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.rand(1)).union(spark.createDataFrame([(9000, 9000), (None, 5)], "a long, b long"))
    got = {r.node: r.label for r in components(edges, "a", "b").collect()}
    assert len(got) == n + 2 and {got[i] for i in range(n + 1)} == {0} and got[9000] == 9000


def test_one_row_of_each_component_stays(spark):
    body = texts(9, 12, 6, 80) + EDGE
    rows = [(i + 1, t, "a") for i, t in enumerate(body)] + [(None, body[0], "b"), (None, "only here and without any id", "c"), (3, body[2], "a"), (3, "some other text of the same id", "d"),
                                                           (None, "only here and without any id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    plain = brute([(i, r[1]) for i, r in enumerate(rows)])
    group = {i: g for i, n, g in plain if n}
    best = {}
    for i, g in group.items():
        best[g] = min(best.get(g, i), i, key=lambda j: (rows[j][0] is None, rows[j][0] or 0, j))
    want = [rows[i] for i in best.values()] + [rows[i] for i, n, _ in plain if not n]
    assert sorted([(r[0], r[1]) for r in kept.collect()], key=str) == sorted([(a, b) for a, b, _ in want], key=str)
