import re

import duckdb
from test_decontaminate import brute as matches
from test_jaccard import brute as linked

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 1").fetchall()}
    clean = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 0").fetchall()}
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        step[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(step[name][1], out.schema)
    before, after = step["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone and not gone & clean and gone & toxic
    before, after = step["near_copies"]
    assert sorted(r.doc_id for r in after) == sorted(d for d, n, c in linked([(r.doc_id, r.text) for r in before]) if d == c)
    before, after = step["decontamination"]
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert sorted(r.doc_id for r in after) == sorted(d for d, n, h, _ in matches([(r.doc_id, r.text) for r in before], bench) if not (h and 20 * h >= n))
    before, after = step["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > 0.4 * len(before)
    before, after = step["sharding"]
    assert [r.doc_id for r in sorted(after)] == [r.doc_id for r in sorted(before)] and all(re.fullmatch(r"shard-\d\d", r.shard) for r in after)
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "shard").collect()) == sorted((r.doc_id, r.shard) for r in after)
