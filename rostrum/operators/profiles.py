"""Person + company -> profile address."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import match as M
from rostrum.functions import relevance as R
from rostrum.functions import text as T
from rostrum.functions import urls as U


def _pairs(people: DataFrame, results: DataFrame) -> DataFrame:
    """Profile rows of each person's own results (equi-join on ``person_id``);
    the address test runs before the join."""
    return results.where(U.is_profile_url(F.col("url"))).join(people, "person_id")  # small filter, runs at the scan


def score_profiles(people: DataFrame, results: DataFrame) -> DataFrame:
    """J3: rows with employer evidence (F4) and their M5 score."""
    rows = _pairs(people, results)
    args = F.col("url"), F.col("title"), F.col("person_name"), F.col("company_name"), F.col("snippet")
    proven = rows.where(R.has_company_evidence(F.col("title"), F.col("snippet"), F.col("url"), F.col("company_name")))
    return T.once(proven, score=M.profile_score(*args))


def best_profile(scored: DataFrame) -> DataFrame:
    """W3. Highest score of at least ten, earliest on ties."""
    rank = F.struct("score", (-F.col("pos")).alias("p"))
    return (scored.where(F.col("score") >= vocab.PROFILE_ACCEPT).groupBy("person_id")
            .agg(F.max_by(F.struct("url", "score", "pos"), rank).alias("b")).select("person_id", "b.*"))


def verify_officers(people: DataFrame, results: DataFrame) -> DataFrame:
    """M6 + W3 (registry variant): every person with url, confidence, reason."""
    args = F.col("url"), F.col("title"), F.col("person_name"), F.col("company_name"), F.col("snippet")
    scored = T.once(_pairs(people, results), score=M.profile_score(*args),
                    ev=R.company_evidence(F.col("title"), F.col("snippet"), F.col("url"), F.col("company_name")))
    rank = F.struct("ev.in_title", "score", (-F.col("pos")).alias("p"))
    proven = (F.col("score") >= vocab.PROFILE_ACCEPT) & (F.col("ev.in_title") | F.col("ev.in_snippet"))
    row = F.struct("url", "score", F.when(F.col("ev.in_title"), "high").otherwise("medium").alias("confidence"))
    per = scored.groupBy("person_id").agg(
        F.max_by(F.when(proven, row), F.when(proven, rank)).alias("best"),
        F.max_by(F.col("score"), rank).alias("top_score"))
    out = people.select("person_id").join(per, "person_id", "left")
    reason = (F.when(F.col("best").isNotNull(), "")
              .when(F.col("top_score").isNull(), f"{vocab.PROFILE_NAME} verification failed: no profile in results")
              .when(F.col("top_score") >= vocab.PROFILE_ACCEPT, f"{vocab.PROFILE_NAME} verification failed: name matched but company did not")
              .otherwise(f"{vocab.PROFILE_NAME} verification failed: no confident name match"))
    return out.select("person_id", F.col("best.url").alias("url"),
                      F.coalesce("best.confidence", F.lit("none")).alias("confidence"), reason.alias("reason"))


def shortlist(scored: DataFrame, n: int = 8, title_chars: int = 160, snippet_chars: int = 200) -> DataFrame:
    """W11. First ``n`` candidates per person, texts cut for the prompt."""
    from pyspark.sql import Window
    w = Window.partitionBy("person_id").orderBy("pos")
    return (scored.withColumn("item", F.row_number().over(w)).where(F.col("item") <= n)
            .select("person_id", "item", "url", F.substring("title", 1, title_chars).alias("title"),
                    F.substring("snippet", 1, snippet_chars).alias("snippet")))


def checked_picks(picks: DataFrame, scored: DataFrame, n: int = 8) -> DataFrame:
    """J6. A model's pick counts only when it is verbatim among the first ``n``
    candidates and its own evidence scores above zero."""
    from pyspark.sql import Window
    w = Window.partitionBy("person_id").orderBy("pos")

    def norm(c: str):
        return F.regexp_replace(F.lower(F.trim(c)), "/$", "")

    listed = (scored.withColumn("item", F.row_number().over(w)).where((F.col("item") <= n) & (F.col("score") > 0))
              .where(F.col("url").rlike(rf"(?i){vocab.PROFILE_HOST_RE}/(?:in|pub)/"))
              .select("person_id", norm("url").alias("norm_url"), "url", "pos"))
    hit = picks.select("person_id", norm("url").alias("norm_url")).join(listed, ["person_id", "norm_url"])
    return hit.groupBy("person_id").agg(F.min_by("url", "pos").alias("url"))
