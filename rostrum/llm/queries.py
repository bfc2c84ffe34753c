"""The registered queries of the package, each over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import decontaminate, embeddings, importance, jaccard, language_id, mixing, prefix_trie, quality_rules, secrets, sharding, token_counts, toxicity, warc
from rostrum.llm.samples import fold


TOXIC = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        decontaminate.is_contaminated().alias("contaminated"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(strong, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(F.expr(secrets.listed("strong")), 256).alias("base_sha256"), F.expr(secrets.listed("spans")).alias("spans"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = embeddings.fit(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1)
    return _judged(embeddings.score(docs, model), 0.5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 3) != 1)
    return _judged(toxicity.score(docs, model), TOXIC)


def _judged(scored: DataFrame, cutoff: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.fit(docs, fold("doc_id", 4) != 2)
    return language_id.predict(docs, filters).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Wanted shares of tokens; values that are not listed share the rest as they come, or keep their natural share where nothing is left.
MIX = {"source": {"src0": 0.1}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}, "topic": {"prose": 0.85}}
MIX_RATE = 0.5


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample(table(spark, sf_dir, "documents"), MIX, MIX_RATE, keep_unlisted=True)
    return mixed.select("doc_id", "source", "lang", "topic", "probability", "sampled")


SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(16)], 4_099


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, SLOTS)
    return placed.select("doc_id", "slot", "shard")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(quality_rules.measured(table(spark, sf_dir, "documents")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & F.col("passes")).alias("kept"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_secrets": op1_secrets, "op2_quality_classifier": op2_quality_classifier, "op3_toxicity": op3_toxicity, "op4_language_id": op4_language_id, "op5_mixing": op5_mixing, "op6_sharding": op6_sharding, "op7_quality_rules": op7_quality_rules, "op8_jaccard_join": op8_jaccard_join, "op9_token_counts": op9_token_counts, "op10_decontamination": op10_decontamination, "op11_warc": op11_warc, "op12_importance": op12_importance, "op13_prefix_trie": op13_prefix_trie}
