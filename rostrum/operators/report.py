"""Report rows and summary."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.sources.sheets import write_workbooks


def _or_null_text(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(vocab.NULL_TEXT))


def status_labels(spark) -> DataFrame:
    """J10 lookup side: a fixed table of thirteen labels."""
    return spark.createDataFrame(list(vocab.STATUS_LABELS.items()), "status string, status_label string")


def with_labels(rows: DataFrame) -> DataFrame:
    """J10."""
    labels = F.broadcast(status_labels(rows.sparkSession))
    return (rows.join(labels, "status", "left").withColumn("status_label", F.coalesce(
        "status_label", F.nullif("status", F.lit("")), F.lit(vocab.NULL_TEXT))))


def report_rows(rows: DataFrame) -> DataFrame:
    """SNK1: the ten report columns with placeholders instead of NULLs."""
    return with_labels(rows).select(
        _or_null_text("company_name").alias("company_name"), _or_null_text("person_name").alias("person_name"),
        _or_null_text("designation").alias("designation"), _or_null_text("profile_url").alias("profile_url"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit(vocab.WEBSITE_SOURCE)).alias("source"), F.col("status_label").alias("status"),
        _or_null_text("din").alias("din"), _or_null_text("appointment_date").alias("appointment_date"),
        _or_null_text("source_url").alias("source_url"), F.coalesce("reason", F.lit("")).alias("reason"))


def write_report(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK1 sink: one file per task, partition-parallel; ``workbooks`` gives
    containers with the report's own headings."""
    if fmt == "workbooks":
        return write_workbooks(report_rows(rows).toDF(*vocab.REPORT_HEADINGS), path, vocab.REPORT_SHEET)
    report_rows(rows).write.mode("errorifexists").option("header", True).format(fmt).save(path)


def summary(rows: DataFrame, cancelled_after: int | None = None, total: int | None = None) -> DataFrame:
    """SNK2 + A7 + A8 + A9 on ``(pos, company_name, person_name, profile_url,
    source, status)`` -> ``(section, metric, value, ord)``; ``ord`` ranks a
    section by descending count, first appearance on ties."""
    def given(c: str) -> Column:
        return ~F.coalesce(F.col(c), F.lit("")).isin("", vocab.NULL_TEXT)

    labelled = with_labels(rows)
    person, linked = given("person_name"), given("person_name") & given("profile_url")
    totals = rows.agg(F.count_distinct("company_name").alias("Total Companies"), F.count_if(person).alias("Rows With People Found"),
                      F.count_if(linked).alias(f"Rows With {vocab.PROFILE_NAME} Found"))
    names = totals.columns
    if total is not None:
        totals = totals.withColumn("Total Companies", F.lit(total).cast("bigint"))
    head = totals.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])).alias("ord", "m")).select(
        F.lit("totals").alias("section"), "m.metric", "m.value", (F.col("ord") + 1).cast("bigint").alias("ord"))

    def breakdown(df: DataFrame, section: str, label: Column) -> DataFrame:
        from pyspark.sql import Window
        counts = df.groupBy(label.alias("metric")).agg(F.count("*").alias("value"), F.min("pos").alias("first"))
        # one row per label or source: bounded by the number of distinct labels
        rank = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(F.col("value").desc(), "first"))
        return counts.select(F.lit(section).alias("section"), "metric", "value", rank.cast("bigint").alias("ord"))

    source = F.coalesce(F.nullif("source", F.lit("")), F.lit(vocab.WEBSITE_SOURCE))
    out = (head.unionByName(breakdown(labelled, "outcome", F.col("status_label")))
           .unionByName(breakdown(rows.where(person), "people by source", source)))
    if cancelled_after is not None:
        note = rows.sparkSession.createDataFrame([("run", f"Cancelled by user after {cancelled_after} of {total} companies", cancelled_after, 1)],
                                                 "section string, metric string, value bigint, ord bigint")
        out = out.unionByName(note)
    return out
