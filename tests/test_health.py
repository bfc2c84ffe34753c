import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostrum.streaming import health as H


def make_events(seed, n=400, keys=3):
    rnd = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rnd.choice([0, 1, 5, 20, 70, 200])
        rows.append((rnd.randrange(keys), pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t), i, rnd.choice(["ok", "empty", "empty", "error"])))
    return pd.DataFrame(rows, columns=["engine", "ts", "event_id", "outcome"])


def expected(pdf, limit):
    out = []
    for k, g in pdf.groupby("engine"):
        g = g.sort_values(["ts", "event_id"])
        streak, until = 0, -1.0
        for r in g.itertuples():
            t = r.ts.timestamp()
            skipped = t < until
            if not skipped:
                if r.outcome == "error":
                    streak, until = 0, t + 90
                elif r.outcome == "empty" and limit:
                    streak, until = streak + 1, -1.0
                    if streak >= limit:
                        streak, until = 0, t + 90
                else:
                    streak, until = 0, -1.0
            out.append((r.event_id, skipped, streak, until))
    return sorted(out)


@pytest.mark.parametrize("limit", [0, 3])
def test_buckets_do_not_change_the_timeline(spark, limit):
    """Any bucket size gives the sequential result, also when pauses span buckets."""
    pdf = make_events(7)
    events = H.engine_events(spark.createDataFrame(pdf)).select("engine", "ts", "event_id", "cool", "is_empty")
    if not limit:
        events = events.withColumn("is_empty", F.lit(False))
    for bucket_rows, slot in ((3, 10), (40, 60), (10**6, 600)):
        got = H.paused_timeline(events, ["engine"], limit=limit, bucket_rows=bucket_rows, slot_seconds=slot).select("event_id", "skipped", "streak", "until").collect()
        assert sorted((r[0], r[1], r[2], r[3]) for r in got) == expected(pdf, limit)


def test_transfer_matches_walk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = rng.integers(1, 30)
        t = np.sort(rng.integers(0, 600, n)).astype(float)
        cool = rng.choice([0, 0, 60, 90, 300], n).astype(float)
        empty = (rng.random(n) < 0.5) & (cool == 0)
        rows, end = H._transfer(t, cool, empty, 3, 90.0, 3600.0)
        for until in [-1.0, *rng.uniform(t[0], t[-1] + 50, 10)]:
            for streak in range(3) if until < 0 else [0]:
                _, s, u = H._walk(t, cool, empty, streak, until, 3, 90.0)
                if until > end:
                    assert (s[-1], u[-1]) == (streak, until)
                    continue
                hit = [r for r in rows if r[0] == streak and r[1] < until <= r[2]]
                assert len(hit) == 1 and (hit[0][3], hit[0][4]) == (s[-1], u[-1])


def test_pause_lengths(spark):
    df = spark.createDataFrame([("CAPTCHA required",), ("HTTP 429",), ("Too many requests",), ("timed out",)], "reason string")
    got = [tuple(r) for r in df.select(H.source_pause(F.col("reason")), H.suspension(F.col("reason"))).collect()]
    assert got == [(300.0, 3600.0), (300.0, 180.0), (60.0, 180.0), (60.0, 60.0)]


def test_cache_entries_expire_and_hits_do_not_renew(spark):
    base = pd.Timestamp("2024-01-01")
    rows = [("q", base + pd.Timedelta(minutes=m), i, n, False) for i, (m, n) in enumerate([(0, 0), (1, 3), (9, 3), (10.9, 3), (11, 3), (12, 3)])]
    df = H.cache_events(spark.createDataFrame(pd.DataFrame(rows, columns=["key", "ts", "event_id", "n_results", "degraded"])))
    got = H.paused_timeline(df.select("key", "ts", "event_id", "cool", "is_empty"), ["key"]).orderBy("event_id").select("skipped").collect()
    assert [r[0] for r in got] == [False, False, True, True, False, True]


def test_stream_equals_batch(spark, tmp_path):
    pdf = make_events(11, 200)
    src = str(tmp_path / "events")
    df = spark.createDataFrame(pdf)
    df.write.parquet(src)
    stream = H.engine_events(spark.readStream.schema(df.schema).parquet(src))
    q = (H.stream_timeline(stream, ["engine"], limit=3).writeStream.format("memory").queryName("health_out").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("health_out").select("event_id", "skipped", "streak", "until").collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in got) == expected(pdf, 3)
