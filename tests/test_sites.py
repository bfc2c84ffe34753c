"""Site scores: what depends on the company alone is worked out once a company."""
import re

from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import urls as U
from rostrum.operators.sites import official_sites


def test_blocked_domains_are_those_of_the_pattern(spark):
    hosts = "|".join(h.replace(".", r"\.") for h in vocab.BLOCKED_HOSTS)
    pattern = re.compile(rf"^$|(?:^|\.)(?:{hosts})\Z|(?:^|\.)(?:{'|'.join(vocab.BLOCKED_LABELS)})(?:\.|\Z)")
    names = [*vocab.BLOCKED_HOSTS, *vocab.BLOCKED_LABELS, "example.com", "", "com", "archive.org.in"]
    doms = [f for n in names for f in (n, "a." + n, "a" + n, "." + n, n + ".", n + ".in", "é." + n, n + "é", "é" + n, "a..b." + n, n.replace(".", "-"))]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(doms)], "i int, d string").select("d", U.is_blocked_domain(F.col("d")).alias("b")).collect()
    assert [(r.d, r.b) for r in got if r.b != bool(pattern.search(r.d))] == []
    odd = spark.createDataFrame([("x.com ",), ("x.com a",)], "d string").select(U.is_blocked_domain(F.col("d")).alias("b")).collect()
    assert [r.b for r in odd] == [True, False]


def test_forms_of_the_brand_are_not_made_for_each_hit(spark):
    companies = spark.createDataFrame([(1, "Blue Sky Foods Ltd"), (2, None), (3, "Ltd"), (1, "Blue Sky Foods Ltd")], "company_id bigint, company_name string")
    hits = spark.createDataFrame([
        (1, 1, 1, "https://www.facebook.com/bsf", "Blue Sky official", None), (1, 1, 2, "https://www.bluesky.com/", None, "blue sky foods"), (1, 1, 3, "https://bsf.com", "x", "y"),
        (1, 2, 1, "https://blueskyfoods.co.in/about", "official", ""), (2, 1, 1, "https://a.com/", "a", "a"), (3, 1, 1, None, None, None)],
        "company_id bigint, variant_no int, pos bigint, url string, title string, snippet string")
    out = official_sites(companies, hits)
    assert [tuple(r) for r in out.collect()] == [(1, 1, "https://bluesky.com/", "bluesky.com", "prefix", 21)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan
    assert not [line for line in plan.splitlines() if "array_join" in line and "url" in line]
