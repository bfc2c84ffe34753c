import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from rostrum.plans.catalog import QUERIES
from rostrum.plans.inputs import view
from rostrum.sources import markup, tables
from rostrum.streaming import health


@pytest.fixture()
def customers(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_rows_of_one_small_file_are_worked_on_by_many_tasks(spark, customers):
    parts = spark.conf.get("spark.rostrum.scan.parts", None)
    spark.conf.unset("spark.rostrum.scan.parts")
    try:
        for name in ("v_registry_page", "v_person"):
            assert view(spark, customers, name).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        if parts is not None:
            spark.conf.set("spark.rostrum.scan.parts", parts)


@pytest.mark.parametrize("name", ["workspace_cards", "people_cards"])
def test_cards_are_parsed_once(spark, customers, name, capsys):
    QUERIES[name](spark, customers).explain()
    assert "MapIn" not in capsys.readouterr().out


def test_table_functions_make_no_frame_for_each_page():
    for function in (tables.RegistryCells, tables.ResultCards, tables.PeopleCardParts):
        assert function.evalType == PythonEvalType.SQL_TABLE_UDF


def test_batches_of_pages_are_cut_into_chunks():
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000))})
    chunks = list(markup._chunks([batch, batch.slice(0, 3)]))
    assert max(c.num_rows for c in chunks) <= 64
    assert [i for c in chunks for i in c.column("page_id").to_pylist()] == [*range(1000), 0, 1, 2]


MARKUP = ["", "plain", "<p>a<p>b<br>c<br/>d</p></p>", '<A HREF="x">q</A><a href=x>r</a><a href="a&amp;b">s</a>', "<script>if (a<b) x('</p>')</script><p>t</p>",
          '<div class="a" class="b" id="">u</div >v</ div><x-y a-b="1">w</x-y>', "<title>a<b>c</title><textarea><p>i</textarea>", "a < b <> </> <!-- <p>no</p> --> <!doctype html><?pi?>z",
          "<table><tr><td>1<td>2<tr><th>3</table>", "<ul><li>a<li>b<ul><li>c</ul></ul>", '<p title="a<b>c">d</p>', "<p>open", "<p", "</p", "<b><i>x</b>y</i>", '<img alt="z"><td>&lt;&copy &#65;</td>']


@pytest.mark.parametrize("html", MARKUP)
def test_plain_tags_are_read_like_others(html):
    class Whole(markup._Page):
        parse_starttag = markup.HTMLParser.parse_starttag
        parse_endtag = markup.HTMLParser.parse_endtag

    for dropped, noisy in ((frozenset({"script", "style", "template"}), False), (markup.DROPPED, True), (markup.INERT, False)):
        was, now = Whole(html, dropped, noisy), markup._Page(html, dropped, noisy)
        for part in ("tag", "parent", "attrs", "start", "end", "last", "text", "owner"):
            assert getattr(now, part) == getattr(was, part)


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_a_bucket_entered_in_any_state_ends_as_the_walk_does(limit):
    rng = np.random.default_rng(limit)
    for n in (1, 2, 40):
        t = np.sort(rng.integers(0, 60, n)).astype(float)
        cool, empty = np.where(rng.random(n) < 0.2, 7.0, 0.0), rng.random(n) < 0.5
        rows, end = health._transfer(t, cool, empty, limit, 5.0, 100.0)
        for streak, lo, hi, out_streak, out_until in rows:
            until = hi if np.isfinite(hi) else t[0]
            _, streaks, untils = health._walk(t, cool, empty, streak, until, limit, 5.0)
            if lo < until <= hi:
                assert (streaks[-1], untils[-1]) == (out_streak, out_until)
