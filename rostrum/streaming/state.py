"""Streams with keyed state that expires: pauses (T2, T3), health read from
the running query's state (T9), answers that miss a deadline (T6, T7).

The processor needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass``."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rostrum import vocab
from rostrum.streaming.health import OPEN, _walk

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PauseProcessor(StatefulProcessor):
    """Replays each key's events in time order on top of its stored pause.

    ``waiting`` holds events until the watermark has passed them, so that late
    ones within its delay take their place; ``pause`` holds the streak and the
    end of the pause, and is removed when both are over; ``success`` holds the
    time of the last good answer.  Each batch of events sets one timer.
    """

    def __init__(self, keys: list[str], order: str, limit: int, pause: float) -> None:
        self.keys, self.order, self.limit, self.length = keys, order, limit, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, o bigint, cool double, is_empty boolean, ok boolean")
        self.pause = handle.getValueState("pause", "streak int, until double")
        self.success = handle.getValueState("success", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            t = pdf["seconds"].astype(float)
            self.waiting.appendList([(float(a), int(o), float(c), bool(e), bool(k)) for a, o, c, e, k in zip(t, pdf["place"], pdf["cool"], pdf["is_empty"], pdf["ok"])])
            last = max(t.max(), t.max() if last is None else last)
        if last is not None:
            self.handle.registerTimer(int(last * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = timerValues.getCurrentWatermarkInMs() / 1000
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [e for e in events if e[0] <= seen], [e for e in events if e[0] > seen]
        if len(rest) < len(events):
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        streak, until = self.pause.get() if self.pause.exists() else (0, OPEN)
        if due:
            t, o, cool, empty, ok = zip(*due)
            skipped, streaks, untils = _walk(*map(np.array, (t, cool, empty)), streak, until, self.limit, self.length)
            streak, until = int(streaks[-1]), float(untils[-1])
            good = [a for a, k, s in zip(t, ok, skipped) if k and not s]
            if good:
                self.success.update((float(good[-1]),))
            out = pd.DataFrame({self.order: o, "skipped": skipped, "streak": streaks, "until": untils})
            for name, value in zip(self.keys, key):
                out[name] = value
            yield out[[*self.keys, self.order, "skipped", "streak", "until"]]
        if until > seen:  # look again when the pause is over
            self.pause.update((streak, until))
            self.handle.registerTimer(int(until * 1000) + 1)
        elif streak:
            self.pause.update((streak, OPEN))
        elif self.pause.exists():
            self.pause.clear()

    def close(self) -> None:
        pass


def pauses(events: DataFrame, keys: list[str], limit: int = 0, order: str = "event_id", delay: str = "10 minutes",
           pause: float = float(vocab.ENGINE_COOLDOWN)) -> DataFrame:
    """T1 to T3 as a stream over ``events(keys, ts, order, outcome, cool,
    is_empty)``: the rows of the batch form as the watermark passes them."""
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema if f.name in keys)
    slim = events.withWatermark("ts", delay).select(*keys, "ts", F.col("ts").cast("double").alias("seconds"), F.col(order).cast("bigint").alias("place"), F.col("cool").cast("double").alias("cool"),
                                                    F.coalesce("is_empty", F.lit(False)).alias("is_empty"), (F.coalesce("outcome", F.lit("")) == "ok").alias("ok"))
    return slim.groupBy(*keys).transformWithStateInPandas(PauseProcessor(keys, order, limit, pause), f"{key_ddl}, {order} bigint, skipped boolean, streak int, until double", "Append", "EventTime")


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a query as a table: its key and value columns."""
    read = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    return read.select("key.*", "value.*")


def snapshot(spark: SparkSession, checkpoint: str, sources: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """T9 from the state of a running :func:`pauses` query, without its events:
    the status of each of ``sources`` at ``now`` (epoch seconds)."""
    held = sources.select(*keys).distinct().join(state_of(spark, checkpoint, "pause"), keys, "left").join(state_of(spark, checkpoint, "success"), keys, "left")
    left = F.greatest(F.coalesce("until", F.lit(OPEN)) - now, F.lit(0.0))
    return held.select(*keys, F.when(F.col("until") > now, "cooldown").when(F.col("at").isNotNull(), "available").otherwise("untested").alias("status"),
                       F.timestamp_seconds("at").alias("last_success"), left.alias("retry_after"))


def missing_by_deadline(expected: DataFrame, arrivals: DataFrame, deadline_seconds: float = 15.0, delay: str = "1 minute") -> DataFrame:
    """T6 + T7 as streams: ``expected(query_id, source, asked_at)`` without an
    answer in ``arrivals(query_id, source, arrived_at)`` by the deadline.  A row
    comes out once both watermarks have passed it."""
    asked = expected.withWatermark("asked_at", delay).select("query_id", "source", "asked_at")
    told = arrivals.withWatermark("arrived_at", delay).select(F.col("query_id").alias("q"), F.col("source").alias("s"), "arrived_at")
    due = F.col("asked_at") + F.expr(f"INTERVAL '{deadline_seconds:f}' SECOND")  # a literal, which the state's watermark can use
    met = (F.col("query_id") == F.col("q")) & (F.col("source") == F.col("s")) & (F.col("arrived_at") >= F.col("asked_at")) & (F.col("arrived_at") <= due)
    return asked.join(told, met, "left_outer").where("arrived_at is null").select("query_id", "source", "asked_at")
