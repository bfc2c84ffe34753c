"""Stored provider responses (JSON text) -> hits ``(query_id, pos, href, title, snippet)``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import once

_HIT = "STRUCT<link: STRING, title: STRING, snippet: STRING>"
SCHEMA_A = (f"knowledgeGraph STRUCT<website: STRING, title: STRING, description: STRING>, "
            f"organic ARRAY<STRUCT<link: STRING, title: STRING, snippet: STRING, sitelinks: ARRAY<{_HIT}>>>")
SCHEMA_B = (f"search_metadata STRUCT<status: STRING>, search_information STRUCT<organic_results_state: STRING>, error STRING, "
            f"knowledge_graph STRUCT<website: STRING, title: STRING, description: STRING>, answer_box {_HIT}, "
            f"organic_results ARRAY<STRUCT<link: STRING, title: STRING, snippet: STRING, "
            f"sitelinks: STRUCT<`inline`: ARRAY<{_HIT}>, expanded: ARRAY<{_HIT}>>>>")
SCHEMA_C = ("results ARRAY<STRUCT<url: STRING, title: STRING, content: STRING, engine: STRING, engines: ARRAY<STRING>>>, "
            "unresponsive_engines ARRAY<ARRAY<STRING>>")


def _hit(link: Column, title: Column, snippet: Column) -> Column:
    return F.struct(link.alias("href"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(snippet, F.lit("")).alias("snippet"))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _emit(df: DataFrame, hits: Column, keep: list[str]) -> DataFrame:
    """Positions count the kept hits, as a list would."""
    kept = F.filter(hits, lambda h: F.coalesce(h["href"], F.lit("")) != "")
    return once(df, hits=kept).select(*keep, F.posexplode("hits").alias("pos", "h")).select(*keep, "pos", "h.*")


def hits_a(responses: DataFrame) -> DataFrame:
    """SRC4: panel, then each organic hit followed by its site links."""
    df = responses.withColumn("j", F.from_json("response", SCHEMA_A))
    kg = F.col("j.knowledgeGraph")

    def with_links(o: Column) -> Column:
        links = F.transform(F.when(F.coalesce(o["link"], F.lit("")) != "", o["sitelinks"]), lambda s: _hit(s["link"], s["title"], F.lit("")))
        return F.concat(F.array(_hit(o["link"], o["title"], o["snippet"])), F.coalesce(links, F.expr("cast(array() as array<struct<href:string,title:string,snippet:string>>)")))

    organic = F.flatten(F.transform(F.col("j.organic"), with_links))
    panel = F.array(_hit(kg["website"], kg["title"], kg["description"]))
    return _emit(df, F.when(organic.isNotNull(), F.concat(panel, organic)).otherwise(panel), ["query_id"])


def status_b(responses: DataFrame) -> DataFrame:
    """SRC5 outcome per response: ``results``, ``empty``, ``key_rejected``, ``quota``, ``failed`` or ``invalid``."""
    df = responses.withColumn("j", F.from_json("response", SCHEMA_B))
    status, error = F.col("j.search_metadata.status"), F.coalesce("j.error", F.lit(""))
    empty = (status == "Success") & (
        F.coalesce("j.search_information.organic_results_state", F.lit("")).rlike("^(?i)fully empty$")
        | error.rlike(r"^(?i)Google hasn't returned any results for this query\.?$"))
    found = F.col("j.organic_results").isNotNull() | F.col("j.knowledge_graph").isNotNull() | F.col("j.answer_box").isNotNull()
    outcome = (F.when(F.col("j").isNull(), "invalid").when(F.coalesce(empty, F.lit(False)), "empty")
               .when(error.rlike("(?i)invalid.*key|unauthorized|forbidden"), "key_rejected")
               .when(error.rlike("(?i)run out of searches|quota|rate limit"), "quota")
               .when((error != "") | (status.isNotNull() & (status != "Success")), "failed")
               .when(status.isNull() & ~found, "invalid").otherwise("results"))
    return df.withColumn("status", outcome)


def hits_b(responses: DataFrame) -> DataFrame:
    """SRC5: panel, answer box, organic hits with inline and expanded site links."""
    df = status_b(responses).where(F.col("status").isin("results", "empty"))
    kg, box = F.col("j.knowledge_graph"), F.col("j.answer_box")
    none = F.expr("cast(array() as array<struct<href:string,title:string,snippet:string>>)")

    def with_links(o: Column) -> Column:
        parts = [F.coalesce(F.transform(o["sitelinks"][k], lambda s: _hit(s["link"], s["title"], s["snippet"])), none) for k in ("inline", "expanded")]
        return F.concat(F.array(_hit(o["link"], o["title"], o["snippet"])), *parts)

    organic = F.coalesce(F.flatten(F.transform(F.col("j.organic_results"), with_links)), none)
    lead = F.array(_hit(kg["website"], kg["title"], kg["description"]), _hit(box["link"], box["title"], box["snippet"]))
    return _emit(df, F.concat(lead, organic), ["query_id"])


def hits_c(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC6: hits with their engines, and the engines reported unresponsive."""
    df = responses.withColumn("j", F.from_json("response", SCHEMA_C)).where(F.col("j.results").isNotNull())
    hits = (df.select("query_id", F.posexplode("j.results").alias("pos", "r")).where(F.col("r.url").isNotNull())
            .select("query_id", "pos", F.col("r.url").alias("href"), F.coalesce("r.title", F.lit("")).alias("title"),
                    F.coalesce("r.content", F.lit("")).alias("snippet"),
                    F.coalesce("r.engines", F.array("r.engine")).alias("engines")))
    reason = F.regexp_replace(F.coalesce(F.get("e", F.lit(1)), F.lit("unavailable")), r"^(?i)Suspended:\s*", "")
    health = (df.select("query_id", F.posexplode("j.unresponsive_engines").alias("pos", "e")).where(F.get("e", F.lit(0)).isNotNull())
              .select("query_id", "pos", F.get("e", F.lit(0)).alias("engine"), reason.alias("reason")))
    return hits, health
