import random

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rostrum.functions import match as M
from rostrum.functions import text as T
from rostrum.operators import registry_link as L

STEMS = ["steel", "motor", "motors", "textil", "bio", "agro", "solar", "zenith", "zenit", "orbit", "orbital", "kiran", "kiram", "ab", "abc", "a", "supplier", "suplier",
         "industries", "trading", "nova", "noba", "xenon", "xenons", "granite", "grantie", "graniteworks", "tata", "tat", "data"]


def some_words(n, seed=5):
    rng = random.Random(seed)
    out = set(STEMS)
    while len(out) < n:
        w = list(rng.choice(STEMS))
        for _ in range(rng.randint(1, 3)):
            i, c = rng.randrange(len(w) + 1), rng.choice("abrst")
            step = rng.randrange(3)
            w[i:i + (step > 0)] = [c] if step < 2 else []
            w = w or ["a"]
        out.add("".join(w))
    return sorted(out)


def test_no_pair_of_matching_words_is_lost(spark):
    words = spark.createDataFrame([(w,) for w in some_words(400)], "word string")
    other = words.select(F.col("word").alias("other"))
    want = words.crossJoin(other).where(T.tokens_match(F.col("word"), F.col("other")))
    got = L.matching_words(words, words)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("split", [2, 50_000])
def test_no_accepted_pair_is_lost(spark, split):
    """Same as comparing every name with every other, also where words are split."""
    rng, words = random.Random(8), some_words(60)
    names = [(" ".join(rng.sample(words, rng.randint(1, 6))) + rng.choice(["", " Ltd", " India Pvt Ltd"]),) for _ in range(160)]
    a, b = (L.comparable_names(spark.createDataFrame(x, "n string"), "n") for x in (names[:80] + [(None,), ("Ltd",)], names[80:]))
    a, b = a.cache(), b.cache()
    x, y = a.select("key", "words").distinct(), b.select(F.col("key").alias("other_key"), F.col("words").alias("other")).distinct()
    want = x.crossJoin(y).withColumn("m", M.name_verdict(M.name_similarity(F.col("words"), F.col("other")))).where("m.accepted").select("key", "other_key", "m.score", "m.confidence")
    got = L.accepted_pairs(a, b, split_rows=split)
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == want


def test_best_entry_and_ties(spark):
    mine = spark.createDataFrame([(1, "Zenith Steel Ltd"), (2, "ZENITH STEEL"), (3, "Unknown Brand"), (4, None)], "company_id int, company_name string")
    theirs = spark.createDataFrame([("R3", "Zenith Steel Private Limited"), ("R2", "zenith steel"), ("R1", "Zenit Steels Motors"), ("R0", None)], "registry_id string, registry_name string")
    got = sorted(map(tuple, L.registry_entries(mine, theirs).collect()))
    assert [(g[0], g[1], g[3]) for g in got] == [(1, "R2", 1.0), (2, "R2", 1.0)] and {g[5] for g in got} == {2}
    assert L.registry_entries(mine, theirs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["registry_name_pairs", "company_registry_whole"])
def test_queries(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) is None
