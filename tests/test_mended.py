"""Literal expectations for inputs that once lost data or broke a job."""
import random

import pytest
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import people as P
from rostrum.functions import text as T
from rostrum.operators import links, results, rows
from rostrum.sources import cells, markup
from rostrum.streaming import health, jobs

NOT_NAMES = ["Hindu Mint", "Reserved Conditions", "Travels Realty", "Asha Labs", "Leading Growth", "Success Story", "Meet Us", "Cement Mills", "Latest Jobs"]


@pytest.mark.parametrize("name,valid", [(n, False) for n in NOT_NAMES] + [("Asha Rao", True), ("Grace Hope", True), ("Forbeses Thises", True)])
def test_words_that_are_no_names(spark, name, valid):
    assert spark.range(1).select(P.is_person_name(F.lit(name), T.company_words(F.lit("Acme Foods Ltd")))).first()[0] is valid


def test_a_title_row_hides_no_column(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('Directors of our clients\nCompany,Director Name,Designation\nAcme Foods,Asha Rao,Chair\nShort Row\n"Kite, Ltd","Bo\nRao",Head,extra\n')
    got = {(r.row_no, r.col_no): r.value for r in cells.read_csv_cells(spark, str(path), multi_line=True).collect()}
    assert got[(1, 1)] == "Directors of our clients" and got[(3, 3)] == "Chair" and got[(4, 1)] == "Short Row" and got[(5, 1)] == "Kite, Ltd"
    assert got[(5, 2)] == "Bo\nRao" and got[(5, 4)] == "extra"
    people = {(r.company, r.person, r.role) for r in cells.sheet_rows(cells.read_csv_cells(spark, str(path), width=3, multi_line=True)).collect()}
    assert ("Acme Foods", "Asha Rao", "Chair") in people and ("Short Row", None, None) in people


def test_anchors_of_every_form(spark):
    html = ("<a class=x href='/board'>Board of <b>Directors</b></a> <A HREF=/team>Team</A> <a href=\"/management\">" + "management " * 60 +
            "</a><a name=n>no address</a><a data-href='/x' href = \"/people?a=1&amp;b=2\" title='t'>People</a>")
    page = spark.createDataFrame([(1, "https://acme.test/", html)], "page_id int, url string, html string")
    got = [(r.href, r.text[:10]) for r in markup.anchors(page).orderBy("pos").collect()]
    assert got == [("/board", "Board of D"), ("/team", "Team"), ("/management", "management"), ("/people?a=1&b=2", "People")]
    assert links.ranked_links(markup.anchors(page)).count() == 4


def test_requests_with_bad_numbers_are_rejected(spark):
    df = spark.createDataFrame([("a", "abc"), ("b", None), ("c", "5"), ("d", "0"), ("e", "2.5")], "q string, num string").withColumns(
        {"engine": F.lit(None).cast("string"), "params": F.array(F.lit("q"))})
    assert {r.q: r.error is None for r in results.check_requests(df).collect()} == {"a": False, "b": True, "c": True, "d": False, "e": False}


def test_job_without_a_total(spark):
    ev = spark.createDataFrame([("j", 1, 1, "progress", None, 0, 0, None, None), ("j", 2, 2, "state", "running", None, None, None, None)],
                               "job_id string, ts int, event_id int, type string, status string, done int, total int, person string, url string")
    assert jobs.job_state(ev).first().percent == 0


def test_events_without_key_or_time_come_out(spark):
    ev = spark.sql("""SELECT * FROM VALUES (1, 'a', timestamp'2024-01-01 00:00:00', 0, false), (2, NULL, timestamp'2024-01-01 00:00:01', 5, false),
        (3, 'a', NULL, 5, false) AS t(event_id, engine, ts, cool, is_empty)""")
    got = {r.event_id: r.skipped for r in health.paused_timeline(ev, ["engine"]).collect()}
    assert got == {1: False, 2: False, 3: False}


def test_a_long_chain_of_names_settles(spark):
    names = ["".join(chr(97 + int(d)) for d in f"{i:03d}") + " rao" for i in range(120)]
    chain = [(1, i * 2 + j, n, f"https://p.test/{i + j}") for i, n in enumerate(names) for j in (0, 1)]
    random.Random(1).shuffle(chain)
    df = spark.createDataFrame(chain, "company_id int, pos int, name string, profile_url string").withColumn("name_key", P.name_key(F.col("name")))
    got = rows._link_names(df).collect()
    assert len(got) == 120 and len({r.person for r in got}) == 1


def test_settings_name_the_site():
    assert vocab.PROFILE_HOST in vocab.BLOCKED_HOSTS and vocab.PROFILE_NAME.lower() in vocab.non_name_words()
