"""Answers of several sources to one query, and once-only warnings (T5-T8)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_acceptable(arrivals: DataFrame, deadline_seconds: float = 15.0) -> DataFrame:
    """T6 + T7 on ``(query_id, asked_at, arrived_at, source, accepted, ...)``: rows
    up to the first accepted one (or the deadline); later answers are dropped."""
    due = F.col("asked_at") + F.make_dt_interval(secs=F.lit(deadline_seconds))
    in_time = F.col("arrived_at") <= due
    cut = (arrivals.where(in_time & F.col("accepted")).groupBy("query_id").agg(F.min("arrived_at").alias("cutoff")))
    return (arrivals.where(in_time).join(cut, "query_id", "left")
            .where(F.col("cutoff").isNull() | (F.col("arrived_at") <= F.col("cutoff"))))


def missing_sources(expected: DataFrame, arrivals: DataFrame) -> DataFrame:
    """T7: sources that had not answered when the query was complete."""
    return expected.join(arrivals.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")


def after_head_start(arrivals: DataFrame, primary: str, seconds: float = 1.5) -> DataFrame:
    """T8, replayed: fallback answers count from the end of the head start, or from
    the primary's own unaccepted answer if that came earlier."""
    miss = (arrivals.where((F.col("source") == primary) & ~F.col("accepted")).groupBy("query_id")
            .agg(F.min("arrived_at").alias("missed_at")))
    start = F.least(F.col("asked_at") + F.make_dt_interval(secs=F.lit(seconds)), F.col("missed_at"))
    return (arrivals.join(miss, "query_id", "left").withColumn("released_at", start)
            .where((F.col("source") == primary) | (F.col("arrived_at") >= F.col("released_at"))).drop("missed_at"))


def warn_once(events: DataFrame, keys: tuple[str, ...] = ("job_id", "engine", "reason")) -> DataFrame:
    """T5, batch: first warning per key."""
    return events.groupBy(*keys).agg(F.min("ts").alias("ts"))


def warn_once_stream(events: DataFrame, keys: tuple[str, ...] = ("job_id", "engine", "reason"), delay: str = "1 day") -> DataFrame:
    """T5, stream: state is kept for ``delay`` of event time."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
