from collections import Counter

import pytest

from rostrum.llm import sharding


def test_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(10)]
    full, less = sharding.fill_table(names, 1009), sharding.fill_table(names[:-1], 1009)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    moved = sum(a != b for a, b in zip(full, less) if a != 9)
    assert moved < 0.2 * 1009
    assert sharding.fill_table(["only"], 2) == [0, 0]
    for bad in ((names, 1008), ([], 7), (["a", "a"], 7), (names, 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_place(spark):
    rows = [(i, "t") for i in range(500)] + [(None, f"t{i}") for i in range(50)] + [(None, None), (7, "other"), (7, "t")]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, shard string")
    names = ["a", "b", "c"]
    got = sharding.place(docs, names, 101).collect()
    table = sharding.fill_table(names, 101)
    assert len(got) == len(rows) and all(r.shard == names[table[r.slot]] for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 3
    assert sharding.place(docs.where("false"), names, 101).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t") for i in range(100)], "doc_id long, text string")
    placed = sharding.place(docs, ["a", "b"], 101)
    sharding.write_shards(placed, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().collect().__len__() == 2
