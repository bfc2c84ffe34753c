"""Table functions against the DataFrame readers of the same pages."""
from pyspark.sql import functions as F

from rostrum.sources import markup, tables

LIST = '<div class="result"><a class="result__a" href="https://a.test/{i}">T {i}</a><div class="result__snippet">S &amp; {i}</div></div>'
REGISTRY = ('<h2>Far</h2><section id="director-information"><h3>Current</h3><p></p><div><table><tr><th>DIN</th><th>Name</th></tr><tr><td>{i}</td><td>N {i}</td></tr>'
            "<tr><td>x</td><td>y</td></tr></table></div><table><tr><td>lone</td></tr></table></section>")
CARDS = ('<div class="entity-result"><span class="entity-result__title-text"><a href="/in/a-{i}">A {i}</a></span><div class="entity-result__primary-subtitle">CEO</div></div>'
         '<div class="entity-result"><a href="/in/b-{i}"><span aria-hidden="true">B</span></a></div>')


def pages(spark, template):
    html = [(i, "list", template.replace("{i}", str(i)) * (i % 3), f"keep {i}", "mine") for i in range(40)]
    return spark.createDataFrame([*html, (40, None, None, None, None), (41, "list", "", "empty", None), (42, "list", "<p>captcha", "bad", None), (43, "feed", "<item><title>T<link>x", "open", None)],
                                 "page_id bigint, layout string, html string, extra string, status string")


def same(reader, found, columns):
    got = sorted(map(repr, found.select("page_id", *columns).collect()))
    assert got == sorted(map(repr, reader.select("page_id", *columns).collect()))
    assert got


def test_result_cards(spark):
    p = pages(spark, LIST)
    found = tables.beside(p, "result_cards(p.layout, p.html)", "t.pos, t.status AS card_status, t.href, t.title, t.snippet")
    same(markup.result_cards(p).withColumnRenamed("status", "card_status"), found, ["pos", "card_status", "href", "title", "snippet"])
    kept = {r.page_id: (r.extra, r.status, r.card_status) for r in found.collect()}
    assert kept[4] == ("keep 4", "mine", "results") and kept[40] == (None, None, "unreadable") and kept[42] == ("bad", None, "blocked")


def test_registry_cells(spark):
    p = pages(spark, REGISTRY)
    found = tables.beside(p, "registry_cells(p.html)")
    same(markup.registry_rows(p), found, ["table_no", "section_present", "heading", "row_no", "headers", "cells"])
    one = found.where("page_id = 1 and table_no >= 0").orderBy("table_no", "row_no")
    assert [(r.heading, r.headers, r.cells, r.extra) for r in one.collect()] == [("", ["din", "name"], ["1", "N 1"], "keep 1"), ("", ["din", "name"], ["x", "y"], "keep 1"), ("", ["lone"], ["lone"], "keep 1")]


def test_people_card_parts(spark):
    p = pages(spark, CARDS)
    found = tables.beside(p, "people_card_parts(p.html)")
    same(markup.people_cards(p), found, ["card_no", "workspace", "hidden", "options", "roots", "hrefs"])


def test_many_tables_keep_the_nearest_heading(spark):
    """The heading is the nearest one before the table or before what is around
    it, however many come before."""
    n = 400
    html = "".join(f"<h3>H {i}</h3><div><ul><li></li></ul><table><tr><th>K</th></tr><tr><td>{i}</td></tr></table></div>" for i in range(n))
    p = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    got = {int(r.cells[0]): r.heading for r in markup.registry_rows(p).where(F.size("cells") > 0).collect()}
    assert got == {i: f"H {i}" for i in range(n)}


def test_plain_sql(spark):
    tables.register(spark)
    pages(spark, LIST).createOrReplaceTempView("saved_pages")
    n = spark.sql("SELECT count(*) AS n FROM saved_pages p, LATERAL result_cards(p.layout, p.html) c WHERE c.status = 'results'").first().n
    assert n == sum(i % 3 for i in range(40))
    assert spark.sql("SELECT * FROM saved_pages p, LATERAL registry_cells(p.html) c WHERE false").count() == 0
