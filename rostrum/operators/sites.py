"""Company -> official site."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import match as M
from rostrum.functions import text as T
from rostrum.functions import urls as U


def official_sites(companies: DataFrame, hits: DataFrame, first_n: int = 12) -> DataFrame:
    """J1 + M1 + M2 + W1.

    ``hits(company_id, variant_no, pos, url, title, snippet)``: the first
    ``first_n`` hits of a variant are scored; the earliest variant whose best
    hit passes decides.
    """
    w = Window.partitionBy("company_id", "variant_no").orderBy("pos")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first_n)
    brands = T.once(T.once(companies.select("company_id", "company_name"), brand=T.brand_tokens(F.col("company_name"))), forms=U.brand_forms(F.col("brand"))).select("company_id", "forms")
    scored = (T.once(top.join(brands, "company_id"), s=M.site_score(F.col("url"), F.col("title"), F.col("snippet"), F.col("forms")))
              .where(F.col("s").isNotNull()).select("company_id", "variant_no", "pos", F.size("forms.words").alias("n_words"), "s"))
    best = (scored.groupBy("company_id", "variant_no").agg(
        F.max_by(F.struct("s.domain", "s.kind", "s.score", "n_words", "pos"),
                 F.struct("s.score", (-F.col("pos")).alias("p"))).alias("b"))
        .where((F.col("b.score") >= 8) | ((F.col("b.n_words") == 1) & (F.col("b.score") >= 4))))
    return (best.groupBy("company_id").agg(F.min(F.struct("variant_no", "b")).alias("v"))
            .select("company_id", "v.variant_no", F.concat(F.lit("https://"), F.col("v.b.domain"), F.lit("/")).alias("url"),
                    F.col("v.b.domain").alias("domain"), F.col("v.b.kind").alias("kind"), F.col("v.b.score").alias("score")))
