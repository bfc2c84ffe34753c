import pytest
from compare import compare, connect

import __spark_entry__ as entry
from rostrum.operators import links
from rostrum.sources import markup

SF = "/root/testdata/sf0.001"
CASES = [
    ("<a href='/one'>One <a href='/two'>Two</a> <a href='/board'>Board", [("/one", "One"), ("/two", "Two"), ("/board", "Board")]),
    ('<ul><li><a href="/a">A<li><a href=/b>B</ul><a href="/c">C', [("/a", "A"), ("/b", "B"), ("/c", "C")]),
    ('<a name="x">no address</a><a href>empty</a><a href="">none</a>', [("", "empty"), ("", "none")]),
    ('<a href="/t&amp;u"><b>Our</b>Team<br>here &amp; <i>now</i></a>', [("/t&u", "Our Team here & now")]),
    ('<script>var s = "<a href=/js>no</a>"</script><!-- <a href="/c">no</a> --><template><a href="/t">no</a></template><a href="/y">yes</a>', [("/y", "yes")]),
    ('<table><tr><td><a href="/1">x<td><a href="/2">y</table>', [("/1", "x"), ("/2", "y")]),
    (None, []), ("", []), ("plain", []),
    ("<a href='/w'>" + "word " * 3000 + "</a>", [("/w", "word " * 2999 + "word")])]


def test_anchors_of_every_form(spark):
    pages = spark.createDataFrame([(i, "https://x.test/", h) for i, (h, _) in enumerate(CASES)], "page_id bigint, url string, html string")
    got = markup.anchors(pages).collect()
    for i, (_, want) in enumerate(CASES):
        assert [(r.href, r.text) for r in sorted(got, key=lambda r: r.pos) if r.page_id == i] == want, i


def test_many_unclosed_anchors_take_linear_time(spark):
    html = "".join(f"<a href='/leadership/{i}'>Team {i} " for i in range(20_000))
    pages = spark.createDataFrame([(1, "https://x.test/", html)], "page_id bigint, url string, html string")
    assert markup.anchors(pages).count() == 20_000


def test_link_text_is_whole_unless_cut(spark):
    pages = spark.createDataFrame([(1, "https://x.test/", f"<a href='/leadership'>{'our team ' * 30}")], "page_id bigint, url string, html string")
    found = markup.anchors(pages)
    assert len(links.ranked_links(found).first().text) == 269 and len(links.ranked_links(found, text_chars=80).first().text) == 80


@pytest.mark.parametrize("name", ["page_links_ranked", "guessed_links", "anchor_snippets", "page_leaders"])
def test_queries(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None
