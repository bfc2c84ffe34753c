"""The corpus pipeline: five stages from raw documents to placed ones.

Each stage works on all rows its predecessor kept and gives back the columns of
documents; the last adds the place."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm import decontaminate, jaccard, mixing, sharding, toxicity
from rostrum.llm.queries import MIX, SHARDS, SLOTS, TOXIC, table
from rostrum.llm.samples import fold
from rostrum.llm.store import shared_table

#: Part of all tokens that the mix keeps.
MIX_RATE = 0.8
#: Learned scores and a calibrated draw have no form in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 3) != 1)
    return toxicity.score(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, MIX, MIX_RATE, keep_unlisted=True).where("sampled").select(*docs.columns)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs, SHARDS, SLOTS)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", place_in_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
