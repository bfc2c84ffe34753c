import datetime
from rostrum.operators import extract
from rostrum.streaming import arrivals, jobs

T0 = datetime.datetime(2024, 1, 1)


def run_stream(df, name, tmp, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)


def job_events(spark):
    t = T0
    rows = [(1, t + datetime.timedelta(seconds=i), i, *r) for i, r in enumerate([
        ("state", "running", None, None, None, None), ("progress", None, 1, 4, None, None), ("row", None, None, None, "p", "u"), ("row", None, None, None, "p", None),
        ("progress", None, 3, 4, None, None), ("state", "cancelled", None, None, None, None), ("state", "finalizing", None, None, None, None)])]
    rows += [(2, t, 90, "state", "done", None, None, None, None)]
    return spark.createDataFrame(rows, "job_id int, ts timestamp, event_id int, type string, status string, done int, total int, person string, url string")


def test_job_state_is_the_same_in_a_stream(spark, tmp_path):
    df = job_events(spark)
    batch = sorted(map(tuple, jobs.job_state(df).collect()))
    assert [(b[1], b[2], b[4], b[5], b[6]) for b in batch] == [("cancelled", 3, 2, 1, 75), ("done", 0, 0, 0, 100)]
    df.write.parquet(str(tmp_path / "in"))
    run_stream(jobs.job_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "job_out", tmp_path, "complete")
    assert sorted(map(tuple, spark.table("job_out").collect())) == batch


def test_warnings_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "bing", "captcha", T0 + datetime.timedelta(seconds=5)), (1, "bing", "captcha", T0), (1, "bing", "429", T0)],
                               "job_id int, engine string, reason string, ts timestamp")
    assert arrivals.warn_once(df).count() == 2
    df.write.parquet(str(tmp_path / "w"))
    run_stream(arrivals.warn_once_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))), "warn_out", tmp_path)
    assert sorted((r.engine, r.reason) for r in spark.table("warn_out").collect()) == [("bing", "429"), ("bing", "captcha")]


def test_feed_appends_rows(spark, tmp_path):
    df = spark.range(5)
    df.write.parquet(str(tmp_path / "rows"))
    jobs.feed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_first_acceptable_answer_ends_the_race(spark):
    t = T0
    rows = [(1, t, t + datetime.timedelta(seconds=s), src, ok) for s, src, ok in ((1, "a", False), (3, "b", True), (4, "c", True), (20, "d", True))]
    rows += [(2, t, t + datetime.timedelta(seconds=s), src, False) for s, src in ((1, "a"), (30, "b"))]
    df = spark.createDataFrame(rows, "query_id int, asked_at timestamp, arrived_at timestamp, source string, accepted boolean")
    kept = arrivals.first_acceptable(df, 15.0)
    assert sorted((r.query_id, r.source) for r in kept.collect()) == [(1, "a"), (1, "b"), (2, "a")]
    assert sorted((r.query_id, r.source) for r in arrivals.missing_sources(df.select("query_id", "source"), kept).collect()) == [(1, "c"), (1, "d"), (2, "b")]
    started = arrivals.after_head_start(df, "a", 3.5)
    assert sorted((r.query_id, r.source) for r in started.collect()) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a"), (2, "b")]


def test_partial_run_and_log_tail(spark):
    ev = job_events(spark)
    assert jobs.partial_rows(ev.where("type = 'row'"), ev.where("status = 'cancelled'").select("job_id", "ts")).count() == 2
    logs = spark.createDataFrame([(1, T0 + datetime.timedelta(seconds=i), i, "log") for i in range(9)], "job_id int, ts timestamp, event_id int, type string")
    assert sorted(r.event_id for r in jobs.log_tail(logs, 3).collect()) == [6, 7, 8]


def test_leaders_from_snippets(spark):
    rows = [(1, "Nykaa", 0, "Nykaa Falguni Nayar - Founder", ""), (1, "Nykaa", 1, "Falguni Nayar, Founder and CEO of Nykaa", "Managing Director Adwaita Nayar speaks"), (1, "Nykaa", 2, "Some Person - Engineer", "")]
    got = sorted((r.name, r.role, r.score) for r in extract.leaders_from_snippets(spark.createDataFrame(rows, "company_id int, company_name string, pos bigint, title string, snippet string")).collect())
    assert [g[0] for g in got] == ["Adwaita Nayar", "Falguni Nayar"] and got[0][1] == "Managing Director" and got[1][1].startswith("Founder and CEO")
