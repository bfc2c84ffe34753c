"""Source health (T1-T3), result cache (T4): one ordered state machine.

All four share a shape.  Per key, events are read in time order; events that
fall before ``until`` are skipped; an event that is read may open a new pause of
``cool`` seconds or, for an empty answer, lengthen a streak that opens one at
its limit.  Streams keep ``(streak, until)`` as keyed state; the batch form
cuts every key's timeline into buckets so that a busy key is spread over many
tasks, works out what each bucket would do for every state it could be entered
with, chains those few rows per key, and replays the buckets.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum import vocab

OPEN = -1.0  # ``until`` of a key without a running pause


# --- event classification -------------------------------------------------------------
def engine_events(df: DataFrame) -> DataFrame:
    """T1. ``outcome`` ok / empty / error -> cool, is_empty (streak limit three)."""
    return (df.withColumn("cool", F.when(F.col("outcome") == "error", float(vocab.ENGINE_COOLDOWN)).otherwise(0.0))
            .withColumn("is_empty", F.col("outcome") == "empty"))


def source_pause(reason: Column) -> Column:
    """T2 pause after an error."""
    return F.when(reason.rlike("(?i)captcha|429|403|202"), float(vocab.HARD_BLOCK_COOLDOWN)).otherwise(float(vocab.SOFT_ERROR_COOLDOWN))


def suspension(reason: Column) -> Column:
    """T3 pause after an upstream engine is reported unresponsive."""
    return (F.when(reason.rlike("(?i)captcha"), float(vocab.CAPTCHA_SUSPENSION))
            .when(reason.rlike("(?i)too many requests|access denied|HTTP 4[02][39]"), float(vocab.RATE_SUSPENSION))
            .otherwise(float(vocab.SOFT_ERROR_COOLDOWN)))


def source_events(df: DataFrame, pause=source_pause) -> DataFrame:
    """T2 / T3. Query-level misses (``irrelevant``) never pause a source."""
    return (df.withColumn("cool", F.when(F.col("outcome") == "error", pause(F.col("reason"))).otherwise(0.0))
            .withColumn("is_empty", F.lit(False)))


def cache_events(df: DataFrame) -> DataFrame:
    """T4 on lookups ``(key, ts, n_results, degraded)``: a miss that finds results
    is stored; hits are the skipped events and never renew the entry."""
    ttl = F.when(F.col("degraded"), float(vocab.DEGRADED_CACHE_TTL)).otherwise(float(vocab.CACHE_TTL))
    return df.withColumn("cool", F.when(F.col("n_results") > 0, ttl).otherwise(0.0)).withColumn("is_empty", F.lit(False))


# --- one bucket ---------------------------------------------------------------------------
def _walk(t, cool, empty, streak, until, limit, pause):
    """Forward pass: skipped flags, state after every event."""
    skipped, streaks, untils = [], [], []
    for at, cooling, is_empty in zip(t.tolist(), cool.tolist(), empty.tolist()):  # plain numbers: array items cost more than the walk
        skip = at < until
        if not skip:
            if cooling > 0:
                streak, until = 0, at + cooling
            elif is_empty and limit:
                streak, until = streak + 1, OPEN
                if streak >= limit:
                    streak, until = 0, at + pause
            else:
                streak, until = 0, OPEN
        skipped.append(skip)
        streaks.append(streak)
        untils.append(until)
    return np.array(skipped, bool), np.array(streaks, np.int32), np.array(untils, float)


def _transfer(t, cool, empty, limit, pause, longest):
    """Exit state for every entry state, as rows ``(streak, lo, hi, out_streak,
    out_until)``: entered with ``lo < until <= hi``.  Computed right to left."""
    n, k = len(t), max(limit, 1)
    ends = t + np.where(cool > 0, cool, pause)  # of the pause that an event opens, and the first event behind it
    behind = np.searchsorted(t, ends, side="left").tolist()
    t, cool, empty, ends = t.tolist(), cool.tolist(), empty.tolist(), ends.tolist()
    out = [None] * n + [[(s, OPEN) for s in range(k)]]
    for i in range(n - 1, -1, -1):
        paused = (0, ends[i]) if behind[i] == n else out[behind[i]][0]
        if cool[i] > 0:
            out[i] = [paused] * k
        elif empty[i] and limit:
            out[i] = [paused if s + 1 >= limit else out[i + 1][s + 1] for s in range(k)]
        else:
            out[i] = [out[i + 1][0]] * k
    rows = [(s, -np.inf, t[0], *out[0][s]) for s in range(k)]
    for i in range(1, n):
        if t[i - 1] - t[0] > longest:
            break
        if t[i] == t[i - 1]:
            continue
        last = rows[-1]
        if last[0] == 0 and i > 1 and last[3:] == out[i][0] and last[2] == t[i - 1]:
            rows[-1] = (0, last[1], t[i], last[3], last[4])
        else:
            rows.append((0, t[i - 1], t[i], *out[i][0]))
    return rows, t[-1]


def paused_timeline(events: DataFrame, keys: list[str], limit: int = 0, bucket_rows: int = 200_000,
                    slot_seconds: int = 600, order: str = "event_id", pause: float = float(vocab.ENGINE_COOLDOWN),
                    longest: float = float(vocab.CAPTCHA_SUSPENSION)) -> DataFrame:
    """Batch form: adds ``skipped``, ``streak`` and ``until`` (epoch seconds, -1 =
    none) to ``events(keys, ts, order, cool, is_empty)``.

    Time slots of a key are packed into buckets of about ``bucket_rows`` events,
    so a quiet key is one bucket and a busy one is spread over many tasks;
    ``longest`` is the longest pause that can occur.  Events without a time, an
    order or a key belong to no timeline: they come out as not skipped.
    """
    named = F.lit(True)
    for c in (*keys, "ts", order):
        named = named & F.col(c).isNotNull()
    loose = events.where(~named).withColumns({"skipped": F.lit(False), "streak": F.lit(0), "until": F.lit(OPEN).cast("double")})
    events = events.where(named)
    t = F.col("ts").cast("timestamp").cast("double")
    slim = events.select(*keys, t.alias("_t"), F.floor(t / slot_seconds).alias("_s"), F.col(order).alias("_o"), "cool", "is_empty")
    slots = slim.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_s")) - F.col("_n")
    slim = slim.join(slots.select(*keys, "_s", F.floor(before / bucket_rows).alias("_b")), [*keys, "_s"]).drop("_s")
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema if f.name in keys)

    def summarise(key, pdf):
        pdf = pdf.sort_values(["_t", "_o"])
        pieces, end = _transfer(pdf["_t"].to_numpy(), pdf["cool"].to_numpy(), pdf["is_empty"].to_numpy(), limit, pause, longest)
        out = pd.DataFrame(pieces, columns=["streak", "lo", "hi", "out_streak", "out_until"])
        out["end_t"] = end
        for name, value in zip(keys + ["_b"], key):
            out[name] = value
        return out

    def chain(key, pdf):
        streak, until, out = 0, OPEN, []
        for b, part in pdf.sort_values("_b").groupby("_b", sort=True):
            out.append((b, streak, until))
            if until > part["end_t"].iloc[0]:
                continue  # the whole bucket is skipped
            hit = part[(part["streak"] == streak) & (part["lo"] < until) & (until <= part["hi"])].iloc[0]
            streak, until = int(hit["out_streak"]), float(hit["out_until"])
        entry = pd.DataFrame(out, columns=["_b", "in_streak", "in_until"])
        for name, value in zip(keys, key):
            entry[name] = value
        return entry

    def replay(key, pdf):
        pdf = pdf.sort_values(["_t", "_o"])
        skipped, streaks, untils = _walk(pdf["_t"].to_numpy(), pdf["cool"].to_numpy(), pdf["is_empty"].to_numpy(),
                                         int(pdf["in_streak"].iloc[0]), float(pdf["in_until"].iloc[0]), limit, pause)
        out = pdf[keys + ["_o"]].copy()
        out["skipped"], out["streak"], out["until"] = skipped, streaks, untils
        return out

    pieces = slim.groupBy(*keys, "_b").applyInPandas(
        summarise, f"{key_ddl}, _b bigint, streak int, lo double, hi double, out_streak int, out_until double, end_t double")
    entry = pieces.groupBy(*keys).applyInPandas(chain, f"{key_ddl}, _b bigint, in_streak int, in_until double")
    state = slim.join(entry, [*keys, "_b"]).groupBy(*keys, "_b").applyInPandas(
        replay, f"{key_ddl}, _o bigint, skipped boolean, streak int, until double")
    return events.join(state.withColumnRenamed("_o", order), [*keys, order]).unionByName(loose)


def health_snapshot(timeline: DataFrame, keys: list[str], now: Column, order: str = "event_id") -> DataFrame:
    """T9: latest state per key at ``now`` (epoch seconds)."""
    last = F.max_by(F.struct("until", "ts"), F.struct("ts", order))
    ok_ts = F.max(F.when(~F.col("skipped") & (F.col("outcome") == "ok"), F.col("ts")))
    left = F.greatest(F.col("l.until") - now, F.lit(0.0))
    return (timeline.groupBy(*keys).agg(last.alias("l"), ok_ts.alias("last_success"))
            .select(*keys, F.when(F.col("l.until") > now, "cooldown").when(F.col("last_success").isNotNull(), "available")
                    .otherwise("untested").alias("status"), "last_success", left.alias("retry_after")))


# --- streaming form -------------------------------------------------------------------------
def stream_timeline(events: DataFrame, keys: list[str], limit: int = 0, order: str = "event_id",
                    pause: float = float(vocab.ENGINE_COOLDOWN)) -> DataFrame:
    """Streaming twin over a watermarked stream; events of one micro-batch are
    replayed in time order on top of the stored state."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema if f.name in keys)

    def step(key, batches, state):
        streak, until = state.get if state.exists else (0, OPEN)
        pdf = pd.concat(list(batches)).sort_values(["_t", "_o"])
        skipped, streaks, untils = _walk(pdf["_t"].to_numpy(), pdf["cool"].to_numpy(), pdf["is_empty"].to_numpy(), streak, until, limit, pause)
        state.update((int(streaks[-1]), float(untils[-1])))
        out = pdf[["_o"]].rename(columns={"_o": order})
        for name, value in zip(keys, key):
            out[name] = value
        out["skipped"], out["streak"], out["until"] = skipped, streaks, untils
        yield out[keys + [order, "skipped", "streak", "until"]]

    slim = events.select(*keys, F.col("ts").cast("double").alias("_t"), F.col(order).alias("_o"), "cool", "is_empty")
    return slim.groupBy(*keys).applyInPandasWithState(
        step, f"{key_ddl}, {order} bigint, skipped boolean, streak int, until double", "streak int, until double",
        "append", GroupStateTimeout.NoTimeout)
