"""Leadership links of a page."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import text as T
from rostrum.functions import urls as U


def ranked_links(anchors: DataFrame, text_chars: int | None = None) -> DataFrame:
    """U15 + F8 on ``(page_id, base, pos, href, text)``: usable same-site links with
    the rank of the first leadership keyword they contain (0 = most promising).
    ``text_chars`` cuts the text, which is whole by default."""
    excluded = rf"(?i){T.WB}(?:{vocab.LINK_EXCLUDE}){T.WE}"
    rows = (anchors.withColumn("text", F.lower("text")).where(~F.col("text").rlike(excluded)))
    rows = (T.once(rows, url=U.page_link(F.col("href"), F.col("base"))).where(F.col("url").isNotNull())
            .where(~U.path(F.col("url")).rlike(excluded)))
    hay = F.concat_ws(" ", F.col("text"), F.lower(U.path(F.col("url"))))
    rank = T.let(hay, lambda h: F.array_position(F.transform(T.one_of(vocab.LINK_KEYWORDS), lambda k: h.contains(k)), F.lit(True)))
    rows = T.once(rows, score=(rank - 1).cast("int")).where(F.col("score") >= 0)
    return (rows.groupBy("page_id", "url").agg(F.min(F.struct("pos", "text", "score")).alias("f"))
            .select("page_id", "url", F.col("f.pos").alias("pos"), (F.substring("f.text", 1, text_chars) if text_chars else F.col("f.text")).alias("text"), F.col("f.score").alias("score")))


def top_links(links: DataFrame, n: int = 5) -> DataFrame:
    """W6."""
    w = Window.partitionBy("page_id").orderBy("score", "pos")
    return links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
