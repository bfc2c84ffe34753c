import pytest
from pyspark.sql import functions as F

from rostrum.functions import relevance as R
from rostrum.operators import extract, profiles, queries as Q
from rostrum.sources import cells, markup, model_output

PAGE = """<html><head><title>People at Kestrel Kilns</title></head><body>
  <header><ul><li>Kilns</li><li>Glazes</li></ul></header>
  <div class="bio"><h2>Noor Haddad</h2><p>Chief Risk Officer</p></div>
  <p>Every plant answers to a director who lives nearby, and each director keeps a diary.</p>
  <table><tr><td><h4>Tomas E. Lindqvist</h4><span>Managing Director</span></td></tr></table>
  <ol><li>Ms. Ines Okafor, Company Secretary</li><li>Dr. Ravi Menon - Independent Director</li></ol>
  <div><p>Chairman: Oskar Benedek Holm</p></div><footer>Kestrel Kilns, est. 1931</footer></body></html>"""
VARIANTS = """<html><body><div>Mina Castellan, Founder and CEO</div><div>Velora Mina Castellan - Founder</div><div>Bloomberg Mina Castellan - Chairperson</div></body></html>"""
CARD_IMAGE = """<html><body><div class="tile"><img alt="Meera Kulkarni"><div><p>Chief Operating Officer</p></div></div></body></html>"""


def people_of(spark, *pages):
    df = spark.createDataFrame([(i, c, h) for i, (c, h) in enumerate(pages)], "page_id bigint, company_name string, html string")
    found = extract.merge_candidates(extract.page_candidates(markup.page_blocks(df)), ("page_id",))
    return sorted((r.page_id, r.name, r.role) for r in extract.merge_name_variants(found, ("page_id",)).collect())


def test_leaders_of_a_mixed_page(spark):
    got = people_of(spark, ("Kestrel Kilns Ltd", PAGE), ("Velora", VARIANTS), ("Acme", CARD_IMAGE))
    assert [g[1:] for g in got if g[0] == 0] == [
        ("Ines Okafor", "Company Secretary"), ("Noor Haddad", "Chief Risk Officer"), ("Oskar Benedek Holm", "Chairman"),
        ("Ravi Menon", "Independent Director"), ("Tomas E. Lindqvist", "Managing Director")]
    assert [g[1] for g in got if g[0] == 1] == ["Mina Castellan"]
    assert [g[1:] for g in got if g[0] == 2] == [("Meera Kulkarni", "Chief Operating Officer")]


def officer_table(heading, *rows, columns=("DIN", "Name", "Designation", "Date of Appointment", "Date of Cessation")):
    line = lambda cell, values: "<tr>" + "".join(f"<{cell}>{v}</{cell}>" for v in values) + "</tr>"
    return f"<h4>{heading}</h4><table>{line('th', columns)}{''.join(line('td', r) for r in rows)}</table>"


TABLES = (officer_table("Current Directors", ("<a href='/p/7'>07770001</a>", "<b>LENA VOSS</b>", "Managing Director", "01/02/2011", "-"),
                        ("07770002", "OMAR TRENT", "Director", "09/10/2018", "N/A"), ("07770003", "PIA LUND", "Director", "09/10/2018", "05/05/2021"))
          + officer_table("Past Directors", ("07770004", "Sven Aho", "Director"), columns=("DIN", "Name", "Designation"))
          + officer_table("Other Directorships", ("U2", "Granite Mills", "Director"), columns=("CIN", "Company Name", "Designation")))
HEAD = ("<html><body><div>Directors of KESTREL KILNS LIMITED are OLD ENTRY.</div>"
        + officer_table("Other contacts", ("Front Desk Clerk", "Director"), columns=("Name", "Role")))


def test_registry_section_is_authoritative(spark):
    pages = spark.createDataFrame([
        (1, "Kestrel Kilns", HEAD + f'<section id="director-information">{TABLES}</section></body></html>'),
        (2, "Kestrel Kilns", HEAD + '<section id="director-information"><h2>Directors</h2></section></body></html>'),
        (3, "Kestrel Kilns", "<html><body><p>Directors of KESTREL KILNS LIMITED are LENA VOSS, OMAR TRENT and IDA QUIST. More.</p></body></html>"),
        (4, "Kestrel Kilns", HEAD + f'<h2 id="director-information">Directors</h2><div>{TABLES}</div></body></html>')], "page_id bigint, company_name string, html string")
    rows = markup.registry_rows(pages)
    got = sorted((r.page_id, r.din, r.person_name, r.designation, r.appointment_date) for r in extract.officers_from_rows(rows, pages).collect())
    want = [("07770001", "LENA VOSS", "Managing Director", "01/02/2011"), ("07770002", "OMAR TRENT", "Director", "09/10/2018")]
    assert got == [(1, *w) for w in want] + [(4, *w) for w in want]
    assert sorted((r.page_id, r.person_name) for r in extract.officers_from_summary(pages, rows).collect()) == [(3, "IDA QUIST"), (3, "LENA VOSS"), (3, "OMAR TRENT")]


def test_registry_statements(spark):
    co, base = "NORTHERN KILN PRIVATE LIMITED", "https://www.zaubacorp.com/"
    page, person = base + "NORTHERN-KILN-PRIVATE-LIMITED-U12345GJ2006PTC123450", base + "MARTA-ELENA-VIDAL-00555123"
    title = "MARTA ELENA VIDAL | ZaubaCorp"
    rows = [(1, co, 0, page, co, "Directors of NORTHERN KILN PRIVATE LIMITED are M. E. VIDAL and JON ARVID BERG. More."), (2, co, 0, person, title, f"Companies Associated With ; {co}, Director, 14-May-2009 ; X LTD, Director, 01-Jan-2010"),
            (3, co, 0, person, title, f"Past Companies Associated With ; {co}, Director, 14-May-2009"), (4, co, 0, person, title, f"Companies Associated With ; {co}, Former Director, 14-May-2009"),
            (5, co, 0, person, "JON ARVID BERG | ZaubaCorp", f"Companies Associated With ; {co}, Director, 14-May-2009"), (6, co, 0, "https://zaubacorp.com.example.test/MARTA-ELENA-VIDAL-00555123", title, f"Companies Associated With ; {co}, Director"),
            (7, co, 0, page, co, "Former Directors of NORTHERN KILN PRIVATE LIMITED are CARA WINTER."), (8, co, 0, page, co, "Directors of NORTHERN GREEN POWER PRIVATE LIMITED are CARA WINTER.")]
    got = sorted((r.company_id, r.person_name, r.din, r.appointment_date) for r in extract.officers_from_index(
        spark.createDataFrame(rows, "company_id int, company_name string, pos bigint, url string, title string, snippet string")).collect())
    assert got == [(1, "JON ARVID BERG", None, None), (1, "M E VIDAL", None, None), (2, "MARTA ELENA VIDAL", "00555123", "14-May-2009")]


def test_input_sheet(spark):
    data = [["My list"], ["Company", "Director Name", "Designation"], ["Acme  Foods", "", ""], ["ACME FOODS", " Asha  Rao ", ""], ["acme foods", "ASHA RAO", "Managing Director"],
            ["Acme Foods", "Bimal Shah", "Director"], ["Other Company", "NULL", ""], ["Third Company", "Rao, Priya", "Founder"]]
    flat = [(r + 1, c + 1, v) for r, row in enumerate(data) for c, v in enumerate(row)]
    people = cells.company_people(cells.sheet_rows(spark.createDataFrame(flat, "row_no bigint, col_no int, value string")))
    got = {r.company_name: [tuple(d) for d in r.directors] for r in cells.companies(people).collect()}
    assert got == {"Acme Foods": [("Asha Rao", "Managing Director"), ("Bimal Shah", "Director")], "Other Company": [], "Third Company": [("Rao, Priya", "Founder")]}
    plain = [(1, 1, ""), (1, 2, "Acme Foods"), (2, 1, "Zen Labs")]
    rows = cells.sheet_rows(spark.createDataFrame(plain, "row_no bigint, col_no int, value string")).orderBy("row_no").collect()
    assert [r.company for r in rows] == ["Acme Foods", "Zen Labs"]
    rich = spark.sql("select named_struct('text', cast(null as string), 'result', '5', 'rich_text', cast(null as array<struct<text:string>>)) v union all "
                     "select named_struct('text', 'a', 'result', cast(null as string), 'rich_text', array(named_struct('text','x'), named_struct('text','y')))")
    assert sorted(r[0] for r in rich.select(cells.cell_text(F.col("v"))).collect()) == ["5", "xy"]


def test_csv_source(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("Company,Name\nAcme,Asha Rao\nAcme,Bimal Shah\n")
    rows = cells.sheet_rows(cells.read_csv_cells(spark, str(p))).orderBy("row_no").collect()
    assert [(r.company, r.person) for r in rows] == [("Acme", "Asha Rao"), ("Acme", "Bimal Shah")]


def test_model_answers(spark):
    rows = [(1, "Acme", 'Sure:\n```json\n[{"name": "Mr. Asha Rao", "designation": "ceo"}, {"name": "Board Members", "designation": "Director"}]\n```'),
            (2, "Acme", 'x [{"name": "Bimal Shah", "designation": ""}] y'), (3, "Acme", "nothing"), (4, "Acme", '[{"name": "Dev Menon", "designation": "Chairman"}]')]
    got = sorted((r.answer_id, r.person_name, r.designation) for r in model_output.validated_people(spark.createDataFrame(rows, "answer_id bigint, company_name string, answer string")).collect())
    assert got == [(1, "Asha Rao", "CEO"), (4, "Dev Menon", "Chairman")]


def test_model_pick_must_be_listed(spark):
    people = spark.createDataFrame([(1, "Arnav Jain", "Plasmagen Biosciences Pvt Ltd")], "person_id int, person_name string, company_name string")
    hits = spark.createDataFrame([(1, 0, "https://in.profiles.example/in/jain-x1", "Arnav Jain | Profilenet", "Plasmagen Biosciences")], "person_id int, pos int, url string, title string, snippet string")
    scored = profiles.score_profiles(people, hits)
    for pick, want in (("https://in.profiles.example/in/JAIN-x1/", 1), ("https://in.profiles.example/in/made-up", 0)):
        assert profiles.checked_picks(spark.createDataFrame([(1, pick)], "person_id int, url string"), scored).count() == want


def test_blocked_pages(spark):
    df = spark.createDataFrame([("", 3, True), ("Access denied", 3, True), ("short", 0, True), ("short", 2, False), ("x" * 600 + " access denied", 0, False)], "t string, n int, want boolean")
    assert df.where(R.looks_blocked(F.col("t"), F.col("n")) != F.col("want")).count() == 0


def test_queries_keep_order_and_drop_repeats(spark):
    df = spark.createDataFrame([("Acme Foods Pvt Ltd", "Asha Rao", None)], "company_name string, person_name string, designation string")
    got = [r.q for r in Q.profile_queries(df).orderBy("variant_no").collect()]
    assert got[:3] == ["Asha Rao Acme Foods Pvt Ltd", "acme foods Asha Rao Profilenet", 'site:profiles.example/in "Asha Rao" "acme foods"'] and len(got) == 9


@pytest.mark.parametrize("layout,html,status", [("list", "<p>Did not match any documents</p>", "empty"), ("list", "<p>Please solve the CAPTCHA</p>", "blocked"), ("card", "<p>hello</p>", "unreadable")])
def test_result_page_outcomes(spark, layout, html, status):
    got = markup.result_cards(spark.createDataFrame([(1, layout, html)], "page_id bigint, layout string, html string")).collect()
    assert [(r.status, r.href) for r in got] == [(status, None)]
