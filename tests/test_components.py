"""Connected components against a sequential search."""
import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import components as module
from rostrum.operators.components import components


def brute(edges):
    label = {}
    for x, y in edges:
        label.setdefault(x, {x})
        label.setdefault(y, {y})
        if label[x] is not label[y]:
            both = label[x] | label[y]
            for n in both:
                label[n] = both
    return {n: min(group) for n, group in label.items()}


def graph(kind):
    rng = random.Random(5)
    if kind == "chain":
        edges = [(i, i + 1) for i in range(300)]
    elif kind == "star":
        edges = [(1000, i) for i in range(400)]
    else:
        edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_equals_a_sequential_search(spark, kind):
    edges = graph(kind)
    table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    assert {r.node: r.label for r in components(table, "a", "b").collect()} == brute(edges)


def test_struct_nodes_nulls_loops_repeats_and_no_edges(spark):
    edges = [(("b", 2), ("a", 9)), (("b", 2), ("a", 9)), (("c", 1), ("c", 1)), (("é", 0), ("z", 5)), (("z", 5), ("b", 2))]
    table = spark.createDataFrame([(x, y) for x, y in edges] + [(None, ("q", 1))], "a struct<k: string, n: bigint>, b struct<k: string, n: bigint>")
    got = {tuple(r.node): tuple(r.label) for r in components(table, "a", "b").collect()}
    assert got == brute(edges)
    assert components(table.where(F.lit(False)), "a", "b").count() == 0


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_many_blocks_over_many_tasks(spark, monkeypatch, kind):
    """Blocks of three links in tasks that adaptive execution leaves apart: the
    rounds have to join what the blocks share."""
    monkeypatch.setattr(module, "BLOCK", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        edges = graph(kind)
        table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
        assert {r.node: r.label for r in components(table, "a", "b").collect()} == brute(edges)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_counted_links_share_tasks(spark, monkeypatch, kind):
    """Told the number of links, rounds put partitions together; the result stays."""
    from rostrum import session
    parts, cut = [], module.cut_lineage

    def counted(df):
        out = cut(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "cut_lineage", counted)
    monkeypatch.setattr(module, "BLOCK", 3)
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        edges = graph(kind)
        table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
        assert {r.node: r.label for r in components(table, "a", "b", len(edges)).collect()} == brute(edges)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(parts) <= 3, parts


def test_fields_that_are_null_come_first(spark):
    table = spark.createDataFrame([((None, 2), ("a", 1)), (("a", 1), ("b", None)), (("b", None), ("b", 0)), (("x", 1), ("x", None))], "a struct<k: string, n: int>, b struct<k: string, n: int>")
    got = {tuple(r.node): tuple(r.label) for r in components(table, "a", "b").collect()}
    assert got == {n: (None, 2) for n in [(None, 2), ("a", 1), ("b", None), ("b", 0)]} | {n: ("x", None) for n in [("x", 1), ("x", None)]}


def test_other_types_are_left_to_the_rounds(spark):
    edges = [(float(x), float(y)) for x, y in graph("random")]
    table = spark.createDataFrame(edges, "a double, b double")
    assert {r.node: r.label for r in components(table, "a", "b").collect()} == brute(edges)
