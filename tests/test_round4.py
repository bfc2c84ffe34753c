"""Registry matching: rows are read and dealt out once, and cheap paths say what the full ones say."""
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import people as P
from rostrum.functions import text as T
from rostrum.functions import urls as U
from rostrum.operators import extract, registry
from rostrum.plans import inputs

HIT = "company_id bigint, company_name string, pos bigint, url string, title string, snippet string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_hits(spark, tmp_path):
    page = "https://www.zaubacorp.com/ACME-FOODS-U12345AA2000PTC000001"
    rows = [(1, "Acme Foods Pvt Ltd", 1, page, "Acme Foods", "Directors of ACME FOODS PVT LTD are Asha Rao and Zoya Lobo."),
            (1, "Acme Foods Pvt Ltd", 2, page, "Acme Foods", "Directors of UNRELATED POWER LIMITED are Om Shah."),
            (1, "Acme Foods Pvt Ltd", 3, "https://www.zaubacorp.com/OM-NAIR-00000007", "OM NAIR | ZaubaCorp", "Companies Associated With ; ACME FOODS, Director, 20-Sep-2006"),
            (1, "Acme Foods Pvt Ltd", 4, "https://www.zaubacorp.com/OM-NAIR-00000007", "OM NAIR | ZaubaCorp", "Companies Associated With ; ACME FOODS, Managing Director, 21-Sep-2006"),
            (1, None, 5, "https://www.zaubacorp.com/OM-NAIR-00000007", "OM NAIR | ZaubaCorp", "Companies Associated With ; ACME FOODS, Director, 20-Sep-2006")]
    spark.createDataFrame(rows, HIT).write.mode("overwrite").parquet(str(tmp_path / "hits"))
    return spark.read.parquet(str(tmp_path / "hits"))


def test_indexed_results_are_read_once_for_each_kind_of_page(spark, tmp_path):
    found = extract.officers_from_index(some_hits(spark, tmp_path))
    assert plan(found).count("FileScan") == 2
    got = sorted((r.person_name, r.designation, r.din, r.appointment_date) for r in found.collect())
    assert got == [("Asha Rao", "Director", None, None), ("OM NAIR", "Director", "00000007", "20-Sep-2006"), ("Zoya Lobo", "Director", None, None)]


def test_candidates_are_dealt_out_once(spark, tmp_path):
    companies = spark.createDataFrame([(1, "Acme Foods Pvt Ltd"), (2, None), (3, "Zenith Solar Ltd")], "company_id bigint, company_name string")
    rows = some_hits(spark, tmp_path).select(F.explode(F.expr("array(1L, 2L, 3L, 4L)")).alias("company_id"), "pos", "url", "title")
    matched = registry.match_candidates(companies, registry.registry_candidates(rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        text = plan(matched)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("FileScan") == 1
    assert text.count("Exchange hashpartitioning") == 2  # the results and the companies
    got = {r.company_id: r.match and (r.match.accepted, r.match.score, r.match.confidence) for r in matched.collect()}
    assert got == {1: (True, 1.0, "high"), 2: None, 3: (False, 0.0, "low")}


def test_a_name_is_judged_the_same_wherever_it_stands(spark):
    """Several candidates of a company with names in common, printed or in the address, and names that are null."""
    companies = spark.createDataFrame([(i, n) for i in (1, 2) for n in (("Acme Foods Pvt Ltd", "Acme Steel") if i == 1 else (None,))], "company_id bigint, company_name string")
    names = ["Acme Foods", "ACME STEEL LIMITED", "Orient Power", None]
    rows = [(c, f"C{i}{j}", i * 10 + j, "u", names[i], names[j]) for c in (1, 2, None) for i in range(4) for j in range(4)]
    candidates = spark.createDataFrame(rows, "company_id bigint, cin string, pos bigint, url string, candidate_name string, alt_name string")
    got = {(r.company_name, r.cin): r.match and r.match.score for r in registry.match_candidates(companies, candidates).where("company_id = 1").collect()}
    score = {(r.a, r.b): r.s for r in spark.createDataFrame([(a, b) for a in ("Acme Foods Pvt Ltd", "Acme Steel") for b in names if b], "a string, b string")
             .select("a", "b", registry.name_match(F.col("b"), T.comparable_tokens(F.col("a")))["score"].alias("s")).collect()}
    assert len(got) == 32
    for (company, cin), s in got.items():
        by_name, by_slug = (score.get((company, names[int(k)])) for k in cin[1:])
        assert s == (by_slug if by_name is None or by_slug is not None and by_slug > by_name else by_name)


def test_the_outcome_is_a_small_plan(spark):
    """Everything known of a company is grouped once; nothing of it is worked out again for officers and outcome."""
    companies = spark.createDataFrame([(1, "Acme Foods")], "company_id bigint, company_name string")
    candidates = spark.createDataFrame([(1, "C", 1, "u", "Acme Foods", "ACME FOODS")], "company_id bigint, cin string, pos bigint, url string, candidate_name string, alt_name string")
    matched = registry.match_candidates(companies, candidates)
    pages = spark.createDataFrame([(1, True)], "company_id bigint, section_present boolean")
    officers = spark.createDataFrame([(1, 5, "Asha Rao")], "company_id bigint, pos bigint, person_name string")
    told, outcome = registry.registry_outcome(companies, matched, matched, pages, officers, officers, officers)
    assert plan(outcome).count("Exchange") <= 4 and plan(told).count("Exchange") == 0
    assert [(r.ok, r.matched_name, r.page_url) for r in outcome.collect()] == [(True, "Acme Foods", "u#director-information")]
    assert [tuple(r) for r in told.collect()] == [(1, 5, "Asha Rao", 1)]


def test_reordered_joins_give_the_rows_of_the_view(spark):
    part = spark.createDataFrame([(i, f"steel rod {i % 3}", i % 7) for i in range(12)] + [(3, "steel rod twice", 1), (None, "steel", 2)], "p_partkey bigint, p_name string, p_size int")
    line = spark.createDataFrame([(i, i % 4, i % 13, i % 5 if i % 9 else None) for i in range(60)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint")
    company = spark.sql(inputs.VIEWS["v_company"], part=part)
    assert set(inputs.REORDERED) <= set(inputs.VIEWS)
    got, want = (spark.sql(texts["v_candidate_hit"], lineitem=line, v_company=company) for texts in (inputs.REORDERED, inputs.VIEWS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_clean_names_are_seen_at_once(spark):
    names = ["Asha Rao", "ASHA RAO", "Mr Rao", "Mr Asha Rao", "asha Dr", "Asha Rao and", "Asha and Rao", "Asha Rao ASHA rao", "Asha Asha", "Asha  Rao", " Asha Rao", "Asha Rao\n",
             "Asha\tRao", "Asha", "", None, "Asha Rao Director", "Managing Rao", "Asha Non", "Late Asha Rao", "Asha Rao,", "A B A B", "Asha R. Rao", "Ásha Rao", "Asha Rao ",
             "a b c a b c", "ab a", "Asha Rao DIN 12", "Of The", "the a", "Mr Mr"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.clean_name(F.col("n")).alias("got"), P._clean_name(F.col("n")).alias("want"))
    assert [tuple(r) for r in rows.where("NOT (got <=> want)").collect()] == []


def test_canonical_registry_addresses_are_only_cut(spark):
    head, cin = f"https://www.{vocab.REGISTRY_HOST}/", "U12345AA2000PTC000001"
    urls = [f"{head}ACME-FOODS-{cin}", f"{head}A-{cin}", f"{head}{cin}", f"{head}-{cin}", f"{head}ACME--FOODS-{cin}", f"{head}ACME-FOODS-{cin}/", f"{head}ACME-FOODS-{cin}\n", f"{head}acme-{cin}",
            f"{head}ACME-{cin}-{cin}", f"{head}ACME-{cin}?x=1", f"{head}ACME-ABC-1234", f"{head}ACME-U1234-{cin}", f"http://{vocab.REGISTRY_HOST}/ACME-{cin}", f"{head}ACME%20X-{cin}",
            f"{head}company/ACME/{cin}", "https://www.zaubacorpxcom/ACME-" + cin, None, ""]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.registry_record(F.col("u")).alias("got"), T.let(F.col("u"), U._registry_record).alias("want"))
    assert [tuple(r) for r in rows.where("NOT (got <=> want)").collect()] == []


def test_texts_without_ampersand_have_no_entities(spark):
    texts = ["a b", "a &amp; b", "&#65;", "a   b  c", None, "", "﻿a\r\nb", "&amp;lt;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.decode_entities(F.col("t")).alias("d"), T.squash(F.col("t")).alias("s")).collect()
    assert [r.d for r in got] == ["a b", "a & b", "A", "a   b  c", "", "", "﻿a\r\nb", "<"]
    assert [r.s for r in got] == ["a b", "a &amp; b", "&#65;", "a b c", "", "", "a b", "&amp;lt;"]
