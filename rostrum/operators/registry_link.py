"""J2 over whole tables: every company name against every registry name.

A pair is accepted when enough words of the company's name have a partner in the
registry's (M3 + M4).  Enough means a fixed share, so a company's name must find
a partner for one of its few rarest words; only those are looked up.  Words are
compared once, as vocabularies: two words that match share their first five
letters or a form with at most two letters deleted.  No block is dropped; words
that many registry names use are split over several tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import match as M
from rostrum.functions import text as T

#: Weight of the covered part of the company's words in M3; the rest is that of the registry's.
COVERAGE = 0.65
#: Registry names of one word that a task gets.
SPLIT_ROWS = 50_000


def _without_one(t: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t))))


def match_keys(t: Column) -> Column:
    """Keys of a word, such that words which match (S14) share one.

    The common form of two words with an edit distance up to d is as long as
    the longer one less d.  A distance of two only counts where the longer word
    has six letters, so shorter words need one deletion at most."""
    once = _without_one(t)
    twice = F.when(F.length(t) >= 6, F.flatten(F.transform(once, _without_one))).otherwise(F.array().cast("array<string>"))
    head = F.when(F.length(t) >= 5, F.array(F.concat(F.lit("^"), t.substr(1, 5)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(t), once, twice, head))


def matching_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """All ``(word, other)`` of two vocabularies (column ``word``) that match."""
    a = left.select("word", F.explode(match_keys(F.col("word"))).alias("key"))
    b = right.select(F.col("word").alias("other"), F.explode(match_keys(F.col("word"))).alias("key"))
    return a.join(b, "key").select("word", "other").distinct().where(T.tokens_match(F.col("word"), F.col("other")))


def comparable_names(rows: DataFrame, column: str) -> DataFrame:
    """Different names of ``column`` as ``name``, ``key`` (its comparable words,
    joined) and ``words``; names without such a word match nothing."""
    named = T.once(rows.select(F.col(column).alias("name")).where("name is not null").distinct(), words=F.array_distinct(T.comparable_tokens(F.col("name"))))
    return named.where(F.size("words") > 0).select("name", F.array_join("words", " ").alias("key"), "words")


def _rarest(names: DataFrame, reach: DataFrame, accept: float) -> DataFrame:
    """The words of each company key of which an accepted pair must match one."""
    least = F.ceil((accept - (1 - COVERAGE)) / COVERAGE * F.size("words") - 1e-9)
    rows = names.select("key", F.size("words").alias("size"), (F.size("words") - F.greatest(least, F.lit(1)) + 1).alias("few"), F.explode("words").alias("word"))
    rows = rows.join(reach, "word", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    order = Window.partitionBy("key").orderBy("reach", "word")  # the words of one name
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("few")).select("key", "size", "word")


def accepted_pairs(companies: DataFrame, registry: DataFrame, accept: float = vocab.MATCH_ACCEPT, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``(key, other_key, score, confidence)`` of all accepted pairs of different
    comparable names: ``companies(key, words)`` against ``registry(key, words)``."""
    companies, registry = (x.select("key", "words").distinct() for x in (companies, registry))
    entries = registry.select(F.col("key").alias("other_key"), F.size("words").alias("other_size"), F.explode("words").alias("other"))
    uses = entries.groupBy("other").agg(F.count(F.lit(1)).alias("uses"))
    pairs = matching_words(companies.select(F.explode("words").alias("word")).distinct(), uses.select(F.col("other").alias("word")))
    pairs = pairs.join(uses, "other")
    reach = pairs.groupBy("word").agg(F.sum("uses").alias("reach"))
    parts = F.ceil(F.col("uses") / split_rows).cast("int")
    asked = _rarest(companies, reach, accept).join(pairs, "word").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = entries.join(uses, "other").withColumn("part", F.pmod(F.xxhash64("other_key"), parts).cast("int")).drop("uses")
    most = F.least("size", "other_size") * (COVERAGE / F.col("size") + (1 - COVERAGE) / F.col("other_size"))
    found = asked.join(dealt, ["other", "part"]).where(most >= accept - 1e-9).select("key", "other_key").distinct()
    told = registry.select(F.col("key").alias("other_key"), F.col("words").alias("other_words"))
    both = found.join(companies, "key").join(told, "other_key")
    judged = T.once(both, match=M.name_verdict(M.name_similarity(F.col("words"), F.col("other_words"))))
    return judged.where("match.accepted").select("key", "other_key", "match.score", "match.confidence")


def registry_entries(companies: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """Best registry entry of every company that has one: ``companies(company_id,
    company_name)``, ``registry(registry_id, registry_name)``.  The highest score
    wins, then the smallest id; ``n_names`` counts the accepted comparable
    names.  Copies of a name are compared once and joined back."""
    mine, theirs = comparable_names(companies, "company_name"), comparable_names(registry, "registry_name")
    pairs = accepted_pairs(mine, theirs, **options)
    first = registry.join(theirs, registry["registry_name"] == theirs["name"]).groupBy(F.col("key").alias("other_key")).agg(
        F.min(F.struct("registry_id", "registry_name")).alias("entry"))
    row = F.struct("entry", "score", "confidence")
    best = pairs.join(first, "other_key").groupBy("key").agg(
        F.min_by(row, F.struct(-F.col("score"), "entry")).alias("b"), F.count(F.lit(1)).alias("n_names"))
    named = companies.join(mine.select(F.col("name").alias("company_name"), "key"), "company_name")
    return named.join(best, "key").select("company_id", "b.entry.registry_id", "b.entry.registry_name", "b.score", "b.confidence", "n_names")
