"""Job progress (T10-T12, A13) and the live row feed (SNK3)."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed values: log lines kept for a job, and shown of them
LOG_KEPT = 2000
LOG_SHOWN = 200


def read_events(raw: DataFrame) -> DataFrame:
    """``(job_id, ts, event_id, payload)``, the payload JSON text or VARIANT, as
    the typed columns of :func:`job_state`, with ``message``.  A field that is
    absent or of another kind is null; so is every field of a payload that is
    no JSON, which ``readable`` tells."""
    payload = F.col("payload") if raw.schema["payload"].dataType.typeName() == "variant" else F.try_parse_json("payload")
    fields = {"type": "string", "status": "string", "done": "int", "total": "int", "person": "string", "url": "string", "message": "string"}
    return raw.withColumn("payload", payload).select(
        "job_id", "ts", "event_id", F.col("payload").isNotNull().alias("readable"),
        *[F.try_variant_get("payload", f"$.{n}", t).alias(n) for n, t in fields.items()])


def _latest(value: Column, when: Column, order: Column) -> Column:
    return F.max_by(F.when(when, value), F.when(when, order))


def job_state(events: DataFrame) -> DataFrame:
    """T10 + A13 on ``(job_id, ts, event_id, type, status, done, total, person,
    url)``.  Every part is a combinable aggregate, so the same function serves a
    batch table and an update-mode stream, and a busy job is summed map-side."""
    order = F.struct("ts", "event_id")
    final = F.col("status").isin("done", "error", "cancelled")
    rows = F.col("type") == "row"
    agg = events.groupBy("job_id").agg(
        F.coalesce(_latest(F.col("status"), final & (F.col("type") == "state"), order),
                   _latest(F.col("status"), F.col("type") == "state", order), F.lit("queued")).alias("status"),
        F.coalesce(_latest(F.col("done"), F.col("type") == "progress", order), F.lit(0)).alias("done"),
        F.max(F.when(F.col("type") == "progress", F.col("total"))).alias("total"),
        F.count_if(rows & F.col("person").isNotNull()).alias("people_rows"),
        F.count_if(rows & F.col("person").isNotNull() & F.col("url").isNotNull()).alias("profile_rows"))
    percent = F.when(F.col("status") == "done", 100).otherwise(
        F.least(F.lit(99), F.round(F.coalesce(F.try_divide("done", "total"), F.lit(0.0)) * 100).cast("int")))
    return agg.withColumn("percent", percent)


def log_tail(events: DataFrame, shown: int = LOG_SHOWN) -> DataFrame:
    """T11: last lines per job, oldest first."""
    w = Window.partitionBy("job_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.where(F.col("type") == "log").withColumn("back", F.row_number().over(w)).where(F.col("back") <= shown)


class TailProcessor(StatefulProcessor):
    """The last lines of each job in a list state of bounded length, in the order
    of time and event; it is cleared when the job has been silent for long enough."""

    def __init__(self, kept: int, shown: int, idle_seconds: float) -> None:
        self.kept, self.shown, self.idle = kept, shown, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "t double, event_id bigint, message string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = list(self.lines.get()) if self.lines.exists() else []
        for pdf in rows:
            new = [(float(t), int(e), m) for t, e, m in zip(pdf["seconds"], pdf["event_id"], pdf["message"])]
            lines = sorted(lines + new, key=lambda x: x[:2])[-self.kept:]
        self.lines.put(lines)
        self.handle.registerTimer(int((lines[-1][0] + self.idle) * 1000))
        tail = lines[-self.shown:]
        yield pd.DataFrame({"job_id": [key[0]] * len(tail), "event_id": [x[1] for x in tail], "message": [x[2] for x in tail], "back": range(len(tail), 0, -1)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lines.exists() and (max(x[0] for x in self.lines.get()) + self.idle) * 1000 <= timerValues.getCurrentWatermarkInMs():
            self.lines.clear()
        return iter(())

    def close(self) -> None:
        pass


def log_tails(events: DataFrame, kept: int = LOG_KEPT, shown: int = LOG_SHOWN, delay: str = "10 minutes", idle_seconds: float = 86_400.0) -> DataFrame:
    """T11 as a stream (update mode): the tail of each job that has new lines, as
    :func:`log_tail` has it.  A job holds ``kept`` lines at most, and none once
    the watermark is ``idle_seconds`` past its last one.  Needs the RocksDB state store."""
    logs = events.where(F.col("type") == "log").withWatermark("ts", delay).select("job_id", "ts", F.col("ts").cast("double").alias("seconds"), F.col("event_id").cast("bigint").alias("event_id"), "message")
    key = events.schema["job_id"].dataType.simpleString()
    return logs.groupBy("job_id").transformWithStateInPandas(
        TailProcessor(kept, shown, idle_seconds), f"job_id {key}, event_id bigint, message string, back int", "Update", "EventTime")


def stored_tail(spark: SparkSession, checkpoint: str, shown: int = LOG_SHOWN) -> DataFrame:
    """The same tail of every job, from the state of a :func:`log_tails` query."""
    lines = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "lines").load().select("key.*", "list_element.*")
    w = Window.partitionBy("job_id").orderBy(F.col("t").desc(), F.col("event_id").desc())  # a job has a bounded number of lines
    return lines.withColumn("back", F.row_number().over(w)).where(F.col("back") <= shown).drop("t")


def partial_rows(rows: DataFrame, cancels: DataFrame) -> DataFrame:
    """T12: rows finished before their job was cancelled (all rows of other jobs)."""
    cut = cancels.groupBy("job_id").agg(F.min("ts").alias("cancel_ts"))
    return (rows.join(cut, "job_id", "left").where(F.col("cancel_ts").isNull() | (F.col("ts") <= F.col("cancel_ts"))))


def feed(rows: DataFrame, path: str, checkpoint: str):
    """SNK3: append every new row to a table; a late listener replays the table."""
    return (rows.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def listen(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """SNK3, the other end: a stream that replays what :func:`feed` has stored
    and then follows it.  The feed's own log names the files of finished
    batches, so a batch that broke off and ran again is seen once; ``files``
    bounds what one step of the replay reads."""
    read = spark.readStream.schema(schema)
    return (read.option("maxFilesPerTrigger", files) if files else read).parquet(path)
