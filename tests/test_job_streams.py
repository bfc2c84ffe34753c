"""Job events as payloads, bounded log tails in state, and the row feed under failures."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from rostrum.streaming import jobs, state

T0 = datetime.datetime(2024, 1, 1)
RAW = "job_id int, ts timestamp, event_id int, payload string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_payloads(spark):
    cases = ['{"type": "log", "message": "a \\"b\\""}', '{"type": "progress", "done": 3, "total": 4.0, "extra": [1]}', '{"type": "progress", "done": "x", "total": null}', "[1]", "{", "", None]
    raw = spark.createDataFrame([(1, T0, i, p) for i, p in enumerate(cases)], RAW)
    want = [(True, "log", None, None, 'a "b"'), (True, "progress", 3, 4, None), (True, "progress", None, None, None), (True, None, None, None, None)] + [(False, None, None, None, None)] * 3
    for df in (raw, raw.withColumn("payload", F.try_parse_json("payload"))):
        assert [(r.readable, r.type, r.done, r.total, r.message) for r in jobs.read_events(df).orderBy("event_id").collect()] == want


def test_tail_in_state_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(3), at(i + rng.choice([0, 0, -40])), i, f'{{"type": "{"log" if i % 3 else "row"}", "message": "m{i}"}}') for i in range(300)]
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    seen = []
    for part in (rows[:120], rows[120:]):
        rng.shuffle(part)
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(path)
        tails = jobs.log_tails(jobs.read_events(spark.readStream.schema(RAW).parquet(path)), kept=20, shown=5)
        q = tails.writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        done = jobs.read_events(spark.read.schema(RAW).parquet(path))
        want = sorted((r.job_id, r.event_id, r.message, r.back) for r in jobs.log_tail(done, 5).collect())
        assert sorted((r.job_id, r.event_id, r.message, r.back) for r in jobs.stored_tail(spark, checkpoint, 5).collect()) == want
        assert sorted(seen[-15:]) == want
    assert jobs.stored_tail(spark, checkpoint, 100).count() == 60  # 20 lines of each job
    spark.createDataFrame([(9, at(10 ** 6), 999, '{"type": "log", "message": "much later"}')], RAW).write.mode("append").parquet(path)
    tails = jobs.log_tails(jobs.read_events(spark.readStream.schema(RAW).parquet(path)), kept=20, shown=5)
    assert tails.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.job_id for r in jobs.stored_tail(spark, checkpoint).collect()] == [9]


def test_feed_that_breaks_off_gives_no_double_and_no_lost_row(spark, tmp_path):
    source, out, schema = str(tmp_path / "rows"), str(tmp_path / "out"), "id bigint"

    def heard():
        q = jobs.listen(spark, out, schema, files=1).writeStream.format("parquet").option("path", str(tmp_path / "heard")).option("checkpointLocation", str(tmp_path / "lcp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "heard")).collect())

    def fed(broken):
        rows = spark.readStream.schema(schema).parquet(source)
        if broken:  # fails after other tasks of the batch have written their files
            rows = rows.withColumn("id", F.when(F.col("id") == 29, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
        return jobs.feed(rows, out, str(tmp_path / "cp")).awaitTermination(120)

    spark.range(0, 10, 1, 2).write.parquet(source)
    fed(False)
    assert heard() == list(range(10))
    spark.range(10, 30, 1, 4).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        fed(True)
    assert heard() == list(range(10))
    fed(False)
    fed(False)
    assert heard() == list(range(30))
    spark.range(30, 35).write.mode("append").parquet(source)
    fed(False)
    assert heard() == list(range(35)) and spark.read.parquet(out).count() == 35
