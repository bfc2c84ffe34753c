import datetime
import random

import pytest
from pyspark.sql import functions as F

from rostrum.streaming import arrivals, health, state

T0 = datetime.datetime(2024, 1, 1)
EVENTS = "source string, ts timestamp, event_id bigint, outcome string, reason string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def some_events(n=240, seed=2):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([1, 5, 20, 90])
        rows.append((rng.choice("abc"), at(t), i, rng.choice(["ok", "empty", "error", "error", "irrelevant"]), rng.choice(["captcha", "HTTP 500", "too many requests"])))
    return rows, t


def run(df, path, checkpoint):
    """Everything that a run leaves in ``path``, of earlier runs too."""
    q = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return df.sparkSession.read.schema(df.schema).parquet(path).collect()


def write(spark, rows, schema, path, part, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)


@pytest.mark.parametrize("pause,limit", [(health.source_pause, 0), (health.suspension, 0), (None, 3)])
def test_pauses_equal_the_batch_form_and_expire(spark, tmp_path, pause, limit):
    """Two runs from one checkpoint, events out of order inside the delay."""
    rows, end = some_events()
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    typed = (lambda df: health.engine_events(df)) if pause is None else (lambda df: health.source_events(df, pause))
    want = health.paused_timeline(typed(spark.createDataFrame(rows, EVENTS)), ["source"], limit).select("source", "event_id", "skipped", "streak", "until").collect()
    rng, first, out = random.Random(3), [r for r in rows if r[2] < 120], str(tmp_path / "out")
    for k, part in enumerate([first, [r for r in rows if r[2] >= 120]]):
        rng.shuffle(part)
        write(spark, part, EVENTS, path, k)
        run(state.pauses(typed(spark.readStream.schema(EVENTS).parquet(path)), ["source"], limit, delay="100 minutes"), out, checkpoint)
    write(spark, [("tick", at(end + 10 ** 6), 10 ** 6, "irrelevant", "")], EVENTS, path, 9)
    got = run(state.pauses(typed(spark.readStream.schema(EVENTS).parquet(path)), ["source"], limit, delay="100 minutes"), out, checkpoint)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)
    left = state.state_of(spark, checkpoint, "pause").collect()
    assert [r for r in left if r["source"] != "tick" and not r["streak"]] == []
    timeline = health.paused_timeline(typed(spark.createDataFrame(rows, EVENTS)), ["source"], limit)
    now = F.lit(T0.replace(tzinfo=datetime.timezone.utc).timestamp() + end + 10 ** 6)
    batch = health.health_snapshot(timeline, ["source"], now)
    stored = state.snapshot(spark, checkpoint, spark.createDataFrame([(c,) for c in "abc"], "source string"), ["source"], now)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, batch.collect()))


def test_snapshot_during_a_pause(spark, tmp_path):
    rows = [("a", at(0), 0, "ok", ""), ("a", at(10), 1, "error", "captcha"), ("b", at(5), 2, "ok", ""), ("tick", at(40), 3, "irrelevant", "")]
    write(spark, rows, EVENTS, str(tmp_path / "in"), 0)
    run(state.pauses(health.source_events(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))), ["source"], delay="1 second"), str(tmp_path / "out"), str(tmp_path / "cp"))
    now = F.lit(T0.replace(tzinfo=datetime.timezone.utc).timestamp() + 60)
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    got = {r["source"]: (r["status"], r["retry_after"]) for r in state.snapshot(spark, str(tmp_path / "cp"), sources, ["source"], now).collect()}
    assert got == {"a": ("cooldown", 250.0), "b": ("available", 0.0), "c": ("untested", 0.0)}


def test_missing_sources_come_out_after_the_deadline(spark, tmp_path):
    asked = [(q, s, at(q * 30)) for q in range(20) for s in "abc"]
    rng = random.Random(6)
    told = [(q, s, at(q * 30 + rng.choice([1, 5, 14, 15, 16, 40]))) for q, s, _ in asked if rng.random() < 0.7]
    late = at(10 ** 5)
    write(spark, asked + [(99, "x", late)], "query_id int, source string, asked_at timestamp", str(tmp_path / "asked"), 0)
    write(spark, told + [(99, "x", late)], "query_id int, source string, arrived_at timestamp", str(tmp_path / "told"), 0)
    left = spark.readStream.schema("query_id int, source string, asked_at timestamp").parquet(str(tmp_path / "asked"))
    right = spark.readStream.schema("query_id int, source string, arrived_at timestamp").parquet(str(tmp_path / "told"))
    got = run(state.missing_by_deadline(left, right), str(tmp_path / "out"), str(tmp_path / "cp"))
    expected = spark.createDataFrame(asked, "query_id int, source string, asked_at timestamp")
    joined = spark.createDataFrame(told, "query_id int, source string, arrived_at timestamp").join(expected, ["query_id", "source"]).withColumn("accepted", F.lit(False))
    want = arrivals.missing_sources(expected.select("query_id", "source"), arrivals.first_acceptable(joined))
    assert sorted((r.query_id, r.source) for r in got) == sorted(map(tuple, want.collect()))
