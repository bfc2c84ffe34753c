"""Search outages in both cascades, against a company-by-company walk."""
import random

from pyspark.sql import functions as F
from test_rows import SCHEMA, key, merge_plain, row

from rostrum.operators import registry, rows
from rostrum.operators.rows import ROW_FIELDS

POOL = "company_id bigint, name_key string, source_rank int, pos bigint, name string, role string, score int, profile_url string"


def walk(site, pool, down, lookups, reg):
    """Rows of one company: one search after the other."""
    def none(status, source="Official Website", reason=None):
        return [dict.fromkeys(ROW_FIELDS) | {"status": status, "source": source, "reason": reason}]

    answered = any(r["person_name"] or r["status"] == "search_unavailable" for r in reg)
    found, outage = {}, None

    def add(rank):
        for p in sorted((p for p in pool if p["source_rank"] == rank), key=lambda p: p["pos"]):
            found.setdefault(p["name_key"], p)

    def titled():
        return sum(bool(p["role"]) for p in found.values())

    if site:
        add(0)
    else:
        if answered:
            return reg
        if "site" in down:
            return none("search_unavailable", "ZaubaCorp", down["site"][0])
    if titled() < 2:
        if "titles" in down:
            outage = down["titles"]
        else:
            add(1)
    if titled() == 0 and not (outage and outage[1]):
        if "snippets" in down:
            outage = down["snippets"]
        else:
            add(2)
    if not found:
        if outage and (outage[1] or not answered):
            return none("search_unavailable", reason=outage[0])
        return reg or none("error")
    people = [p for p in found.values() if p["role"] or not titled()]
    people.sort(key=lambda p: (not p["profile_url"], not p["role"], -p["score"], p["source_rank"], p["pos"]))
    out, stop = [], outage if outage and outage[1] else None
    for i, p in enumerate(people[:8]):
        url, said = p["profile_url"], None
        if not url and stop:
            said = stop[0]
        elif not url:
            url, said, blocking = lookups.get(p["name_key"], (None, None, False))
            said = None if url else said
            if said and blocking:
                stop = (said, True)
        out.append(dict.fromkeys(ROW_FIELDS) | {"pos": i, "person_name": p["name"], "designation": p["role"] or "Director", "profile_url": url, "source": "Official Website",
                                                "status": "ok" if url else "search_unavailable" if said else "no_profile", "reason": said})
    if not stop and any(not r["profile_url"] for r in out):
        return merge_plain(out, reg)
    return out


def test_main_cascade_equals_a_walk(spark):
    rnd = random.Random(8)
    names = ["Asha Rao", "Bimal Shah", "Chitra Nair", "Dev Menon", "Esha Iyer", "Farid Khan"]
    sites, pool, downs, looks, regs = [], [], [], [], []
    for c in range(240):
        if rnd.random() < 0.7:
            sites.append((c,))
        for pos, n in enumerate(rnd.sample(names, rnd.choice([0, 0, 1, 2, 4]))):
            rank = rnd.choice([0, 1, 2]) if (c,) in sites else rnd.choice([1, 2])
            pool.append((c, key(n), rank, pos, n, rnd.choice(["CEO", "CFO", None, ""]), pos % 3, rnd.choice([None, None, f"k{pos}"])))
        for step in rows.STEPS:
            if rnd.random() < 0.35:
                downs.append((c, step, f"{step} down", rnd.random() < 0.5))
        for n in names:
            if rnd.random() < 0.6:
                url = rnd.choice([None, f"u-{key(n)}"])
                said = None if url else rnd.choice([None, "limited"])
                looks.append((c, key(n), url, said, bool(said) and rnd.random() < 0.5))
        for pos in range(rnd.choice([0, 1, 1, 2])):
            n = rnd.choice(names)
            if pos == 0 and rnd.random() < 0.5:
                regs.append(row(c, 0, None, None, rnd.choice(["zauba_not_found", "search_unavailable"]), "ZaubaCorp", reason="why", role=None))
                break
            if all(r[0] != c or r[2] != n for r in regs):
                regs.append(row(c, pos, n, rnd.choice([None, f"r{pos}"]), "ok", "ZaubaCorp", f"{pos:08d}", None, "s"))
    companies = spark.range(240).toDF("company_id")
    people = spark.createDataFrame(pool, POOL)
    outages = rows.search_outages(companies, people, spark.createDataFrame(downs, "company_id bigint, step string, reason string, blocking boolean"))
    leaders = rows.rank_people(rows.website_leaders(people, outages))
    got = rows.resolve_companies(companies, spark.createDataFrame(sites, "company_id bigint"), leaders,
                                 spark.createDataFrame(looks, "company_id bigint, name_key string, url string, outage string, blocking boolean"),
                                 spark.createDataFrame(regs, SCHEMA), outages)
    fields = POOL.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    want, kinds = [], set()
    for c in range(240):
        reg = [dict(zip(["company_id", "pos", *ROW_FIELDS], r)) for r in regs if r[0] == c]
        out = walk((c,) in sites, [dict(zip(fields, p)) for p in pool if p[0] == c], {d[1]: d[2:] for d in downs if d[0] == c}, {x[1]: x[2:] for x in looks if x[0] == c}, reg)
        want += [repr((c, *[r[f] for f in ROW_FIELDS])) for r in out]
        kinds |= {(r["status"], r["source"], r["reason"]) for r in out if not r["person_name"]}
    assert sorted(repr(tuple(r)) for r in got.select("company_id", *ROW_FIELDS).collect()) == sorted(want)
    assert {("search_unavailable", "ZaubaCorp", "site down"), ("search_unavailable", "Official Website", "titles down"),
            ("search_unavailable", "Official Website", "snippets down")} <= kinds


def test_known_address_is_not_looked_up(spark):
    """An outage recorded for a person with an address stops nobody."""
    companies = spark.range(1).toDF("company_id")
    people = spark.createDataFrame([(0, "asha-rao", 0, 0, "Asha Rao", "CEO", 1, "u"), (0, "dev-menon", 0, 1, "Dev Menon", "CFO", 1, None)], POOL)
    looks = spark.createDataFrame([(0, "asha-rao", None, "captcha", True), (0, "dev-menon", "v", None, False)], "company_id bigint, name_key string, url string, outage string, blocking boolean")
    got = rows.resolve_companies(companies, companies, rows.rank_people(rows.website_leaders(people)), looks, spark.createDataFrame([], SCHEMA))
    assert sorted((r.person_name, r.profile_url, r.status) for r in got.collect()) == [("Asha Rao", "u", "ok"), ("Dev Menon", "v", "ok")]


def test_no_outage_changes_nothing(spark):
    companies = spark.range(3).toDF("company_id")
    people = spark.createDataFrame([(0, "asha-rao", 0, 0, "Asha Rao", "CEO", 1, "u"), (1, "dev-menon", 2, 0, "Dev Menon", None, 1, None)], POOL)
    empty = spark.createDataFrame([], "company_id bigint, step string, reason string, blocking boolean")
    none = rows.search_outages(companies, people, empty)
    assert none.count() == 0
    looks = spark.createDataFrame([], "company_id bigint, name_key string, url string, outage string, blocking boolean")
    reg = spark.createDataFrame([], SCHEMA)
    a, b = (sorted(map(repr, rows.resolve_companies(companies, companies, rows.rank_people(rows.website_leaders(people, *o)), looks, reg, *o).collect())) for o in ((), (none,)))
    assert a == b and len(a) == 3


def test_repeated_and_null_outages(spark):
    companies = spark.range(2).toDF("company_id")
    people = spark.createDataFrame([], POOL)
    downs = spark.createDataFrame([(0, "titles", "b", True), (0, "titles", "a", False), (0, "titles", "c", True), (1, "snippets", None, None), (None, "site", "x", True), (1, "other", "y", True)],
                                  "company_id bigint, step string, reason string, blocking boolean")
    got = {r.company_id: (r.site_reason, r.reason, r.blocking, r.no_titles, r.no_snippets) for r in rows.search_outages(companies, people, downs).collect()}
    assert got == {0: (None, "b", True, True, True), 1: (None, "", False, False, True)}


CAND = "company_id bigint, cin string, pos int, url string, candidate_name string, alt_name string, match struct<accepted: boolean, score: double, confidence: string>"


def look_up(web, site, page, on_page, indexed, followup, down):
    best = next((x for x in web if x), None) if "web" not in down else None
    seen = bool(web) and "web" not in down
    if not best and "site" not in down:
        seen, best = seen or bool(site), next((x for x in site if x), None)
    if not best:
        no_site = f"ZaubaCorp site search could not be loaded: {down.get('site')}"
        if "web" in down:
            return [], "; ".join([f"ZaubaCorp company search could not recover after: {down['web']}"] + [no_site] * ("site" in down)), True
        return [], no_site if "site" in down else "Company match confidence too low" if seen else "ZaubaCorp page not found", False
    people = on_page if page is not None else []
    if not people and not page:
        people = indexed if "web" not in down else []
        if not people and "officers" in down:
            return [], f"ZaubaCorp company matched, but director information could not be recovered: {down['officers']}", True
        people = people or followup
    if people:
        return people, "", False
    return [], "Directors unavailable" if page is not None else "ZaubaCorp page could not be loaded; indexed results did not identify directors", False


def test_registry_cascade_equals_a_walk(spark):
    rnd = random.Random(4)
    webs, sites, pages, officers, downs, want = [], [], [], {1: [], 2: [], 3: []}, [], {}
    for c in range(400):
        def hits(n):
            return [rnd.random() < 0.5 for _ in range(rnd.choice([0, 1, n]))]
        web, site = hits(2), hits(2)
        for into, found in ((webs, web), (sites, site)):
            into += [(c, f"c{i}", i, f"https://www.zaubacorp.com/c{i}", "N", "N", (ok, 0.9 - i / 10, "high")) for i, ok in enumerate(found)]
        page = rnd.choice([None, False, True])
        if page is not None:
            pages.append((c, page))
        told = {}
        for s in officers:
            told[s] = [f"p{s}{i}" for i in range(rnd.choice([0, 0, 2]))] if s > 1 or page is not None else []
            officers[s] += [(c, i, n, "Director") for i, n in enumerate(told[s])]
        down = {step: f"{step} out" for step in registry.OUTAGE_STEPS if rnd.random() < 0.3}
        downs += [(c, step, m) for step, m in down.items()]
        want[c] = look_up(web, site, page, told[1], told[2], told[3], down)
    o = [spark.createDataFrame(officers[s], "company_id bigint, pos int, person_name string, designation string") for s in (1, 2, 3)]
    people, outcome = registry.registry_outcome(spark.range(400).toDF("company_id"), spark.createDataFrame(webs, CAND), spark.createDataFrame(sites, CAND),
                                                spark.createDataFrame(pages, "company_id bigint, section_present boolean"), *o,
                                                spark.createDataFrame(downs, "company_id bigint, step string, message string"))
    named = {}
    for r in people.orderBy("company_id", "pos").collect():
        named.setdefault(r.company_id, []).append(r.person_name)
    got = {r.company_id: (named.get(r.company_id, []), r.reason, r.unavailable) for r in outcome.collect()}
    assert got == want
    assert all(r.ok == bool(named.get(r.company_id)) for r in outcome.collect())


def test_registry_rows_of_outages_and_indexed_officers(spark):
    officers = spark.createDataFrame([(1, 0, "Asha Rao", "Director", "https://www.zaubacorp.com/ASHA-RAO-00000001", "Index"), (2, 0, "Bimal Shah", "", None, None)],
                                     "company_id bigint, pos int, person_name string, designation string, source_url string, source string")
    outcome = spark.createDataFrame([(1, "https://www.zaubacorp.com/A#s", True, "", False), (2, "https://www.zaubacorp.com/B#s", True, "", False),
                                     (3, None, False, "ZaubaCorp company search could not recover after: x", True), (4, None, False, "ZaubaCorp site search could not be loaded: y", False)],
                                    "company_id bigint, page_url string, ok boolean, reason string, unavailable boolean")
    looks = spark.createDataFrame([], "company_id bigint, name_key string, url string, confidence string, outage string, blocking boolean")
    got = {r.company_id: (r.person_name, r.designation, r.status, r.source, r.source_url) for r in rows.registry_people_rows(officers, outcome, looks).collect()}
    assert got == {1: ("Asha Rao", "Director", "profile_unverified", "Index", "https://www.zaubacorp.com/ASHA-RAO-00000001"),
                   2: ("Bimal Shah", "Director", "profile_unverified", "ZaubaCorp", "https://www.zaubacorp.com/B#s"),
                   3: (None, None, "search_unavailable", "ZaubaCorp", None), 4: (None, None, "zauba_unreachable", "ZaubaCorp", None)}
    assert outcome.where(F.col("unavailable")).count() == 1
