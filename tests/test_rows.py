import random

from pyspark.sql import functions as F

from rostrum.operators import extract, results, rows
from rostrum.operators.rows import ROW_FIELDS

SCHEMA = "company_id bigint, pos bigint, " + ", ".join(f"{c} string" for c in ROW_FIELDS)


def row(company, pos, name, url=None, status="no_profile", source="Official Website", din=None, reason=None, source_url=None, role="Director"):
    return (company, pos, name, role, url, status, source, din, None, source_url, reason)


def key(name):
    return "-".join(sorted({t for t in "".join(c for c in (name or "").lower() if c.isalpha() and c.isascii() or c == " ").split(" ") if len(t) > 1}))


def merge_plain(site, reg):
    """One company, one row after another."""
    lost = next((r for r in reg if not r["person_name"] and r["status"] == "search_unavailable"), None)
    out = []
    for r in site:
        r = dict(r)
        if not r["profile_url"] and lost:
            r.update(status="search_unavailable", reason=lost["reason"], source_url=r["source_url"] or lost["source_url"])
        out.append(r)
    for g in reg:
        if not g["person_name"]:
            continue
        at = next((i for i, r in enumerate(out) if key(r["person_name"]) == key(g["person_name"]) or (r["profile_url"] and r["profile_url"] == g["profile_url"])), None)
        if at is None:
            out.append(dict(g))
            continue
        old = out[at]
        url = old["profile_url"] or g["profile_url"]
        down = g if g["status"] == "search_unavailable" else old if old["status"] == "search_unavailable" else None
        new = {**old, **g, "pos": old["pos"], "profile_url": url}
        new["status"] = old["status"] if old["profile_url"] else g["status"] if url else (down or g)["status"]
        new["source"] = old["source"] if old["profile_url"] else g["source"]
        new["reason"] = None if url else (down["reason"] if down and down["reason"] else g["reason"] or old["reason"])
        out[at] = new
    return out


def test_merge_matches_sequential_merge(spark):
    rnd = random.Random(5)
    names = ["Asha Rao", "Rao Asha", "Bimal Shah", "B. Shah", "Chitra Nair", "Dev Menon", "Esha Iyer"]
    urls = [None, None, "u1", "u2", "u3"]
    site, reg = [], []
    for c in range(60):
        seen = set()
        for p in range(rnd.randrange(4)):
            n = rnd.choice(names)
            if key(n) in seen:
                continue
            seen.add(key(n))
            site.append(row(c, p, n, rnd.choice(urls), rnd.choice(["ok", "no_profile", "search_unavailable"]), reason=rnd.choice([None, "w"])))
        for p in range(rnd.randrange(7)):
            n = rnd.choice(names + [None])
            reg.append(row(c, p, n, rnd.choice(urls) if n else None, rnd.choice(["ok", "profile_unverified", "search_unavailable"]), "ZaubaCorp", f"{p:08d}", rnd.choice([None, "r"]), "s"))
    s, r = spark.createDataFrame(site, SCHEMA), spark.createDataFrame(reg, SCHEMA)
    got = sorted(repr(tuple(x)) for x in rows.merge_director_rows(s, r).select("company_id", *ROW_FIELDS).collect())
    names_ = ["company_id", "pos", *ROW_FIELDS]
    want = []
    for c in range(60):
        a = [dict(zip(names_, x)) for x in site if x[0] == c]
        b = [dict(zip(names_, x)) for x in reg if x[0] == c]
        want += [repr((c, *[m[f] for f in ROW_FIELDS])) for m in merge_plain(a, b)]
    assert got == sorted(want)


def test_chain_of_shared_addresses(spark):
    """A and C never share a key or an address, B ties them through its own."""
    site = spark.createDataFrame([row(1, 0, "Asha Rao", "u1", "ok")], SCHEMA)
    reg = spark.createDataFrame([row(1, 0, "Bimal Shah", "u1", "ok", "ZaubaCorp"), row(1, 1, "Bimal Shah", "u2", "ok", "ZaubaCorp"), row(1, 2, "Chitra Nair", "u2", "ok", "ZaubaCorp")], SCHEMA)
    got = [(r.person_name, r.profile_url) for r in rows.merge_director_rows(site, reg).orderBy("late", "pos").collect()]
    assert got == [("Bimal Shah", "u1"), ("Chitra Nair", "u2")]


def test_outages(spark):
    df = spark.createDataFrame([(1, 1, "a", None, False), (1, 2, None, "partial", False), (1, 3, None, "captcha", True), (1, 4, "x", None, False), (2, 1, None, "partial", False), (2, 2, "b", None, False)],
                               "company_id int, person_pos int, url string, outage string, blocking boolean")
    got = {(r.company_id, r.person_pos): (r.url, r.outage) for r in rows.spread_outages(df).collect()}
    assert got == {(1, 1): ("a", None), (1, 2): (None, "partial"), (1, 3): (None, "captcha"), (1, 4): (None, "captcha"), (2, 1): (None, "partial"), (2, 2): ("b", None)}


def test_fallback_order(spark):
    people = spark.createDataFrame([
        (1, "asha-rao", 0, 1, "Asha Rao", "CEO"), (1, "dev-x", 0, 2, "Dev X", "CFO"), (1, "t-one", 1, 3, "T One", "CEO"),   # two titled: titles not read
        (2, "bimal-shah", 0, 1, "Bimal Shah", ""), (2, "t-two", 1, 2, "T Two", "CEO"), (2, "s-two", 2, 3, "S Two", "CEO"),  # titles read, snippets not
        (3, "chitra-nair", 0, 1, "Chitra Nair", None), (3, "s-three", 2, 2, "S Three", "CEO"), (4, "lone-name", 0, 1, "Lone Name", None)],
        "company_id int, name_key string, source_rank int, pos int, name string, role string")
    got = sorted((r.company_id, r.name) for r in rows.website_leaders(people).collect())
    assert got == [(1, "Asha Rao"), (1, "Dev X"), (2, "T Two"), (3, "S Three"), (4, "Lone Name")]


def test_cascade_ways(spark):
    companies = spark.createDataFrame([(i,) for i in range(1, 6)], "company_id bigint")
    sites = companies.where("company_id in (2, 3, 4)")
    leaders = spark.createDataFrame([(2, "asha-rao", "Asha Rao", "CEO", 1, "u9", 0, 0), (3, "bimal-shah", "Bimal Shah", "CFO", 1, None, 0, 0)],
                                    "company_id bigint, name_key string, name string, role string, rank int, profile_url string, source_rank int, pos bigint")
    lookups = spark.createDataFrame([(3, "bimal-shah", None, None, False)], "company_id bigint, name_key string, url string, outage string, blocking boolean")
    registry = spark.createDataFrame([row(1, 0, "Reg One", "r1", "ok", "ZaubaCorp"), row(3, 0, "Bimal Shah", "b1", "ok", "ZaubaCorp", "00000001"), row(4, 0, None, None, "zauba_not_found", "ZaubaCorp")], SCHEMA)
    got = {(r.company_id, r.person_name, r.profile_url, r.status, r.source) for r in rows.resolve_companies(companies, sites, leaders, lookups, registry).collect()}
    assert got == {(1, "Reg One", "r1", "ok", "ZaubaCorp"), (2, "Asha Rao", "u9", "ok", "Official Website"), (3, "Bimal Shah", "b1", "ok", "ZaubaCorp"),
                   (4, None, None, "zauba_not_found", "ZaubaCorp"), (5, None, None, "error", "Official Website")}


def test_name_variants_fold_into_shortest(spark):
    people = [(1, "Falguni Nayar", "Founder", 4), (1, "Ey Falguni Nayar", "Founder and CEO", 9), (1, "Ey Falguni Sanjay Nayar", "Chair", 1), (1, "A. Gupta", "CEO", 2), (1, "Anil Gupta", "CFO", 2), (1, "Sunil Gupta", "CFO", 2)]
    df = spark.createDataFrame([(c, n, r, s, i) for i, (c, n, r, s) in enumerate(people)], "company_id int, name string, role string, score int, ord bigint")
    merged = extract.merge_name_variants(extract.merge_candidates(df, ("company_id",)), ("company_id",))
    assert sorted((r.name, r.role, r.score) for r in merged.collect()) == [("A. Gupta", "CEO", 2), ("Anil Gupta", "CFO", 2), ("Falguni Nayar", "Founder and CEO", 14), ("Sunil Gupta", "CFO", 2)]


def test_merge_does_not_depend_on_partitioning(spark):
    rnd = random.Random(2)
    data = [(q, i, f"https://a.test/p{rnd.randrange(4)}", "t" * rnd.randrange(1, 9), rnd.choice(["x y", "y", "longer text", "", "text"]), rnd.choice("ab")) for q in range(3) for i in range(40)]
    base = spark.createDataFrame(data, "query_id int, pos int, url string, title string, snippet string, source string")
    want = sorted(map(repr, results.merge_sources(base).collect()))
    for n in (1, 7):
        shuffled = base.orderBy(F.rand(n)).repartition(n)
        assert sorted(map(repr, results.merge_sources(shuffled).collect())) == want


def test_regional_profiles_merge(spark):
    rows_ = [(1, 0, "https://in.profiles.example/in/Asha-Rao", "Asha Rao", "one", "searxng"), (1, 1, "https://www.profiles.example/in/asha-rao/?trk=search", "Asha Rao - CEO", "two", "brave")]
    got = results.merge_sources(spark.createDataFrame(rows_, "query_id int, pos int, url string, title string, snippet string, source string")).collect()
    assert [(r.url, r.title, r.snippet, r.sources) for r in got] == [("https://in.profiles.example/in/Asha-Rao", "Asha Rao - CEO", "one two", ["searxng", "brave"])]
