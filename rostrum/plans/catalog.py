"""Registered queries: every operator over its whole input tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import match as M
from rostrum.functions import people as P
from rostrum.functions import relevance as R
from rostrum.functions import text as T
from rostrum.functions import urls as U
from rostrum.operators import extract, links, profiles, queries as Q, registry, registry_link, report, results, rows, sites
from rostrum.plans.inputs import view
from rostrum.session import cut_lineage, shared_folder
from rostrum.sources import cells, markup, model_output, search_json, sheets, tables
from rostrum.streaming import arrivals, health, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- addresses -------------------------------------------------------------------------
@query
def url_canonical(spark, sf):
    u = F.col("url")
    return (view(spark, sf, "pages").select("page_id", U.result_url(u).alias("result_url"), U.strip_url(u).alias("plain_url"), U.domain(u).alias("domain"),
                                            U.merge_key(U.result_url(u)).alias("merge_key"), U.display_url(u).alias("shown")))


@query
def url_unwrap(spark, sf):
    return view(spark, sf, "v_wrapped").select("page_id", U.unwrap_url(F.col("href")).alias("url"))


@query
def domain_core_rollup(spark, sf):
    d = view(spark, sf, "pages").select(U.domain(F.col("url")).alias("domain"), U.is_blocked_host(F.col("url")).alias("blocked"))
    return d.groupBy(U.domain_core(F.col("domain")).alias("core"), "blocked").agg(F.count("*").alias("pages"), F.count_distinct("domain").alias("domains"))


@query
def host_variants(spark, sf):
    return Q.host_variants(view(spark, sf, "pages").select("page_id", "url"))


# --- results -----------------------------------------------------------------------------
@query
def result_merge(spark, sf):
    m = results.merge_sources(view(spark, sf, "v_result"))
    return m.select("query_id", "url", "title", "snippet", F.array_join("sources", ",").alias("sources"), "first_pos")


@query
def result_merge_fuller_title(spark, sf):
    return results.merge_fuller_title(view(spark, sf, "v_result").withColumnRenamed("url", "href"))


@query
def relevance_filter(spark, sf):
    r = view(spark, sf, "v_result").withColumn("engines", F.when(F.col("source") == "b", F.array(F.lit("bing"))).otherwise(F.array("source")))
    return results.relevant(view(spark, sf, "v_query"), r, min_coverage=0.3, low_trust_engine="bing").select("query_id", "pos", "source")


@query
def accepted_first_topn(spark, sf):
    merged = results.merge_sources(view(spark, sf, "v_result"))
    return results.accepted_first(merged, F.col("snippet").contains("the"), limit=5).select("query_id", "position", "url", "accepted")


@query
def search_response(spark, sf):
    merged = results.merge_sources(view(spark, sf, "v_result"))
    return results.response_json(results.accepted_first(merged, F.lit(True), limit=10)).select(
        "query_id", "num", F.get_json_object("response", "$.organic[0].link").alias("first_link"),
        F.get_json_object("response", "$.organic_results[0].title").alias("first_title"))


@query
def variant_early_stop(spark, sf):
    hits = view(spark, sf, "v_variant_hit")
    kept = results.early_stop(hits, ("query_id",), accepted="accepted", enough=2)
    return results.best_evidence(kept, ("query_id",), "accepted").select("query_id", "url", "variant_no", "pos", "accepted")


@query
def variant_stop_any(spark, sf):
    return (results.early_stop(view(spark, sf, "v_variant_hit"), ("query_id",)).groupBy("query_id")
            .agg(F.count("*").alias("rows_kept"), F.max("variant_no").alias("last_variant")))


@query
def longest_snippet(spark, sf):
    return results.longest_snippet(view(spark, sf, "v_profile_hit").select("url", "pos", "snippet"), ())


@query
def request_checks(spark, sf):
    req = view(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("q"), (F.col("turn") * 13).alias("num"),
                                                   F.when(F.col("turn") % 2 == 0, "google").otherwise("web").alias("engine"), F.array(F.lit("q"), F.lit("num")).alias("params"))
    return results.check_requests(req).select("conv_id", "turn", "error")


# --- input lists ----------------------------------------------------------------------------
@query
def input_header_ingest(spark, sf):
    return cells.sheet_rows(view(spark, sf, "v_cells"))


@query
def company_group_people(spark, sf):
    return cells.company_people(cells.sheet_rows(view(spark, sf, "v_cells")))


@query
def supplied_people(spark, sf):
    people = cells.company_people(cells.sheet_rows(view(spark, sf, "v_cells")))
    return cells.supplied_people(cells.companies(people))


# --- names -------------------------------------------------------------------------------------
@query
def company_keys(spark, sf):
    n = F.col("company_name")
    return view(spark, sf, "v_company").select(
        "company_id", T.company_key(n).alias("key"), F.array_join(T.brand_tokens(n), " ").alias("brand"), F.array_join(T.comparable_tokens(n), " ").alias("comparable"),
        F.array_join(T.company_words(n), " ").alias("words"), T.same_company(n, F.col("p_name")).alias("same"))


@query
def query_plan_table(spark, sf):
    people = view(spark, sf, "v_person").select("person_id", "company_name", F.concat_ws(" ", "fn", F.lit("Kumar"), "ln").alias("person_name"),
                                               F.when(F.col("person_id") % 2 == 0, F.col("role")).alias("designation"), F.lit(None).cast("string").alias("matched_name"))
    parts = [Q.site_queries(people), Q.registry_queries(people), Q.profile_queries(people), Q.verify_queries(people), Q.title_queries(people), Q.snippet_queries(people),
             Q.people_search_terms(people)]
    out = [p.select("person_id", "kind", "variant_no", "q") for p in parts]
    slug = Q.registry_slug(people).select("person_id", F.lit("slug").alias("kind"), F.lit(1).alias("variant_no"), F.col("slug").alias("q"))
    for p in out[1:] + [slug]:
        out[0] = out[0].unionByName(p)
    return out[0]


@query
def person_name_clean(spark, sf):
    return view(spark, sf, "v_raw_name").select("person_id", P.clean_name(F.col("raw_name")).alias("name"))


@query
def person_name_filter(spark, sf):
    n = view(spark, sf, "v_raw_name").withColumn("name", P.clean_name(F.col("raw_name")))
    return n.select("person_id", P.is_person_name(F.col("name"), T.company_words(F.col("company_name"))).alias("valid"), P.name_key(F.col("name")).alias("name_key"),
                    P.short_name(F.col("name")).alias("short_name"))


@query
def role_normalise(spark, sf):
    p = view(spark, sf, "v_person").withColumn("raw", F.concat(F.lower("role"), F.lit(" bio of "), F.col("fn")))
    return p.select("person_id", P.normalize_role("raw").alias("role"), P.is_senior(F.col("raw")).alias("senior"), P.role_quality(F.col("raw")).alias("quality"),
                    F.size(P.find_roles(F.col("raw"))).alias("n_roles"), P.is_role_label(F.col("role")).alias("label"))


# --- company matching ------------------------------------------------------------------------------
@query
def site_candidates_best(spark, sf):
    return sites.official_sites(view(spark, sf, "v_company"), view(spark, sf, "v_hit"))


@query
def company_registry_link(spark, sf):
    cand = registry.registry_candidates(view(spark, sf, "v_candidate_hit"))
    return registry.best_candidate(registry.match_candidates(view(spark, sf, "v_company"), cand)).select("company_id", "cin", "candidate_name", "score", "confidence")


@query
def registry_name_pairs(spark, sf):
    mine = registry_link.comparable_names(view(spark, sf, "v_company"), "company_name")
    return registry_link.accepted_pairs(mine, registry_link.comparable_names(view(spark, sf, "v_registry"), "registry_name"))


@query
def company_registry_whole(spark, sf):
    return registry_link.registry_entries(view(spark, sf, "v_company").select("company_id", "company_name"), view(spark, sf, "v_registry"))


# --- pages ----------------------------------------------------------------------------------------
@query
def page_links_ranked(spark, sf):
    pages = view(spark, sf, "v_page").select("page_id", "url", F.replace("html", F.lit("</ul></nav>"), F.lit(
        '<li><a href="/our-team/">Our Team</a></li><li><a href="leadership?x=1#top">Leadership</a></li><li><a href="/blog/board">Board news</a></li></ul></nav>')).alias("html"))
    found = links.ranked_links(markup.anchors(pages), text_chars=80)
    return links.top_links(found).select("page_id", "rank", "url", "text", "score")


@query
def guessed_links(spark, sf):
    pages = view(spark, sf, "pages")
    return Q.guessed_links(pages.select("page_id", "url"), links.ranked_links(markup.anchors(pages)))


@query
def page_text_blocked(spark, sf):
    p = view(spark, sf, "pages").select("page_id", markup.page_text(F.col("html")).alias("text"), F.regexp_count("html", F.lit("(?i)<a[\\s>]")).alias("links"))
    return p.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), R.looks_blocked(F.col("text"), F.col("links")).alias("blocked"))


@query
def html_blocks(spark, sf):
    return markup.flat_blocks(markup.page_blocks(view(spark, sf, "v_leader_page")))


@query
def anchor_snippets(spark, sf):
    pages = view(spark, sf, "v_page")
    card = Q.fill('<div class="hit"><p><a href="{u}">Team page {i}</a></p><p>Who runs the company, who sits on its board and since when they do so</p></div></body>', u=F.col("url"), i=F.col("page_id").cast("string"))
    return markup.anchor_snippets(pages.select("page_id", F.concat(F.regexp_replace("html", "(?s)<footer>.*$", ""), card).alias("html")), snippet_chars=300)


@query
def page_leaders(spark, sf):
    found = extract.page_candidates(markup.page_blocks(view(spark, sf, "v_leader_page")))
    per_page = extract.merge_name_variants(extract.merge_candidates(found, ("page_id",)), ("page_id",))
    return extract.rank_in(per_page, ("page_id",)).select("page_id", "rank", "name", "role", "score")


@query
def company_leaders(spark, sf):
    pages = view(spark, sf, "v_leader_page")
    found = extract.page_candidates(markup.page_blocks(pages))
    per_page = (extract.merge_name_variants(extract.merge_candidates(found, ("page_id",)), ("page_id",))
                .join(pages.select("page_id", "company_id", "visit_no"), "page_id"))
    capped = extract.within_people_cap(per_page.withColumn("visit_no", F.col("visit_no") % 5))
    total = extract.merge_candidates(capped.withColumn("ord", F.col("visit_no") * 1000 + F.col("ord") % 1000), ("company_id",), F.when(F.col("visit_no") > 0, 2).otherwise(0))
    return extract.prefer_titled(total, ("company_id",)).select("company_id", "name", "role", "score")


@query
def richest_page(spark, sf):
    people = view(spark, sf, "v_title_hit").select("company_id", F.col("pos").alias("page_id"), F.col("pos").alias("visit_no"), F.explode(P.title_parts(F.col("title"))).alias("name"))
    return extract.richest_page(people)


@query
def name_variant_merge(spark, sf):
    people = (view(spark, sf, "v_raw_name").join(view(spark, sf, "v_person").select("person_id", "role"), "person_id")
              .withColumn("name", P.clean_name(F.col("raw_name"))).select("company_id", "name", "role", F.lit(3).alias("score"), F.col("person_id").alias("ord")))
    merged = extract.merge_candidates(people, ("company_id",))
    return extract.merge_name_variants(merged, ("company_id",)).select("company_id", "name_key", "name", "role", "score")


# --- registry ----------------------------------------------------------------------------------------
@query
def registry_officers(spark, sf):
    pages = view(spark, sf, "v_registry_page")
    rows_ = markup.registry_rows(pages)
    return extract.officers_from_rows(rows_, pages).select("page_id", "person_name", "designation", "din", "appointment_date")


@query
def registry_summary(spark, sf):
    pages = view(spark, sf, "v_registry_page")
    return extract.officers_from_summary(pages, cut_lineage(markup.registry_rows(pages))).select("page_id", "person_name", "designation")


@query
def registry_index(spark, sf):
    return extract.officers_from_index(view(spark, sf, "v_index_hit")).select("company_id", "person_name", "designation", "din", "appointment_date", "source_url")


def _registry(spark, sf, found=None, opened=None):
    """C7 over the registry pages; ``found`` / ``opened`` say which companies a
    search finds and whose page loads."""
    pages = view(spark, sf, "v_registry_page")
    companies = pages.select("company_id", F.lit("Kestrel Foods Private Limited").alias("company_name"))
    hits = pages.select("company_id", F.lit(1).alias("pos"), F.concat(F.lit("https://www.zaubacorp.com/"), F.when(F.col("company_id") % 5 == 0, "OTHER-POWER").otherwise("KESTREL-FOODS"),
                        F.lit("-U12345AA2000PTC"), F.lpad((F.col("company_id") % 1000000).cast("string"), 6, "0")).alias("url"), F.lit("").alias("title"))
    matched = registry.match_candidates(companies, registry.registry_candidates(hits if found is None else hits.where(found)))
    pages = pages if opened is None else pages.where(opened)
    rows_ = cut_lineage(markup.registry_rows(pages))
    cols = ["company_id", "pos", "person_name", "designation"]
    on_page = extract.officers_from_rows(rows_, pages).withColumn("company_id", F.col("page_id")).select(*cols)
    summary = extract.officers_from_summary(pages, rows_).withColumn("company_id", F.col("page_id")).select(*cols)
    loaded = (pages.select("company_id").join(rows_.select(F.col("page_id").alias("company_id"), "section_present"), "company_id", "left")
              .select("company_id", F.coalesce("section_present", F.lit(False)).alias("section_present")))
    none = on_page.where(F.lit(False))
    return registry.registry_outcome(companies, matched, matched.where(F.lit(False)), loaded, on_page.unionByName(summary), none, none)


@query
def registry_cascade(spark, sf):
    officers, outcome = _registry(spark, sf)
    n = officers.groupBy("company_id").agg(F.count("*").alias("officers"))
    status = F.when(F.col("ok"), rows.person_status(F.lit(None), F.col("confidence"), F.lit(None), "profile_unverified")).otherwise(rows.registry_status(F.col("reason")))
    return outcome.join(n, "company_id", "left").select("company_id", "ok", "reason", "confidence", F.coalesce("officers", F.lit(0)).alias("officers"), status.alias("status"))


@query
def registry_rows(spark, sf):
    """Registry people to result rows; every fourth person is found for sure,
    found with less confidence, not found, or met by an outage."""
    officers, outcome = map(cut_lineage, _registry(spark, sf, F.col("company_id") % 7 != 0, F.col("company_id") % 11 != 0))
    turn = (F.col("company_id") + F.row_number().over(Window.partitionBy("company_id").orderBy("pos"))) % 4
    lookups = officers.withColumn("turn", turn).select(
        "company_id", P.name_key(F.col("person_name")).alias("name_key"), F.when(F.col("turn") < 2, F.concat(F.lit("https://p.test/"), F.col("company_id").cast("string"))).alias("url"),
        F.when(F.col("turn") == 1, "medium").otherwise("high").alias("confidence"), F.when(F.col("turn") == 3, "search down").alias("outage"), F.lit(False).alias("blocking"))
    out = rows.registry_people_rows(officers, outcome, lookups)
    return out.groupBy("company_id", "status").agg(F.count("*").alias("n"), F.count("person_name").alias("people"), F.count("profile_url").alias("profiles"), F.min("reason").alias("reason"))


@query
def registry_stages(spark, sf):
    """C7 with all its sources: web and site candidates, pages, indexed and
    follow-up officers, and outages of each search.  What the searches of a company
    gave follows from the sum of the nations of its people (``w``); officers are
    looked up among the company's people."""
    people = view(spark, sf, "v_person")
    companies = cut_lineage(people.groupBy("company_id", "company_name").agg(F.sum("c_nationkey").alias("w")))
    luck = companies.select("company_id", "w", (F.col("w") % 7).alias("luck"))
    hits = cut_lineage(view(spark, sf, "v_index_hit").join(luck, "company_id"))
    hits = hits.withColumn("snippet", F.when(F.col("w") % 5 < 4, F.col("snippet")))
    other = F.when(F.col("luck") == 4, F.lit("OTHER-POWER"))
    asked = hits.withColumn("url", F.when(other.isNotNull(), F.regexp_replace("url", "(zaubacorp.com/).*(-U)", F.concat(F.lit("$1"), other, F.lit("$2")))).otherwise(F.col("url")))
    asked = asked.withColumn("title", F.when(other.isNull(), F.col("title")).otherwise(F.lit("")))
    matched = cut_lineage(registry.match_candidates(companies, registry.registry_candidates(asked)).join(luck.select("company_id", "luck"), "company_id"))
    by_web = F.col("luck").isin(0, 1, 2, 5)
    found = cut_lineage(extract.officers_from_index(hits).join(luck.select("company_id", "luck"), "company_id"))
    pages = (view(spark, sf, "v_registry_page").withColumn("company_id", F.col("page_id") - 1).join(luck, "company_id").where(F.col("w") % 11 < 6)
             .withColumn("html", F.when(F.col("w") % 11 == 5, F.regexp_replace("html", "Directors of", "People of")).otherwise(F.col("html"))))
    rows_ = cut_lineage(markup.registry_rows(pages))
    on_page = extract.officers_from_rows(rows_, pages).unionByName(extract.officers_from_summary(pages, rows_), allowMissingColumns=True)
    on_page = on_page.withColumn("company_id", F.col("page_id") - 1).drop("page_id")
    loaded = (pages.select("company_id", "page_id").join(rows_.select("page_id", "section_present"), "page_id", "left")
              .select("company_id", F.coalesce("section_present", F.lit(False)).alias("section_present")))
    w = F.col("w")
    down = F.array(F.when(F.col("luck") == 5, "web"), F.when((F.col("luck") == 6) | ((F.col("luck") == 5) & (w % 2 == 1)), "site"), F.when(w % 3 == 0, "officers"))
    outages = luck.select("company_id", F.explode(F.array_compact(down)).alias("step")).withColumn("message", F.concat("step", F.lit(" limited")))
    officers, outcome = registry.registry_outcome(companies, matched.where(by_web).drop("luck"), matched.where(F.col("luck").isin(3, 4, 5, 6)).drop("luck"), loaded, on_page,
                                                  found.where(by_web).drop("luck"), found.where(~by_web).drop("luck"), outages)
    known = (people.select("company_id", P.name_key(F.concat_ws(" ", "fn", "ln")).alias("name_key")).distinct()
             .select("*", F.concat(F.lit("https://p.test/"), "name_key").alias("url"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("outage"), F.lit(False).alias("blocking")))
    out = rows.registry_people_rows(officers.drop("name_key"), outcome, known)
    return out.select("company_id", "person_name", "designation", "din", "status", "source", "reason")


# --- profiles -------------------------------------------------------------------------------------------
def _people(spark, sf):
    return view(spark, sf, "v_person").select("person_id", F.concat_ws(" ", "fn", "ln").alias("person_name"), "company_name")


@query
def profile_link_best(spark, sf):
    return profiles.best_profile(profiles.score_profiles(_people(spark, sf), view(spark, sf, "v_profile_hit")))


@query
def officer_verification(spark, sf):
    return profiles.verify_officers(_people(spark, sf), view(spark, sf, "v_profile_hit"))


@query
def profile_shortlist(spark, sf):
    return profiles.shortlist(profiles.score_profiles(_people(spark, sf), view(spark, sf, "v_profile_hit"))).select("person_id", "item", "url")


@query
def model_picks(spark, sf):
    scored = profiles.score_profiles(_people(spark, sf), view(spark, sf, "v_profile_hit"))
    picks = view(spark, sf, "v_profile_hit").where(U.is_profile_url(F.col("url"))).select("person_id", F.concat(F.upper("url"), F.lit("/")).alias("url"))
    return profiles.checked_picks(picks, scored)


@query
def title_leaders(spark, sf):
    return extract.leaders_from_titles(view(spark, sf, "v_title_hit")).select("company_id", "name_key", "name", "role", "url", "pos")


@query
def profile_leaders(spark, sf):
    hits = view(spark, sf, "v_title_hit").withColumn("headline", F.lit("")).withColumn("card_name", F.lit(""))
    return extract.leader_from_profile(hits).select("company_id", "pos", "url", "name", "role")


@query
def snippet_leaders(spark, sf):
    return extract.leaders_from_snippets(view(spark, sf, "v_title_hit")).select("company_id", "name_key", "name", "role", "score")


@query
def model_output_people(spark, sf):
    return model_output.validated_people(view(spark, sf, "v_answer"))


# --- stored responses and saved pages -----------------------------------------------------------------------
@query
def search_json_a(spark, sf):
    j = view(spark, sf, "v_page").select(F.col("page_id").alias("query_id"), F.to_json(F.struct(
        F.struct(F.col("url").alias("website"), F.lit("T").alias("title"), F.lit("d").alias("description")).alias("knowledgeGraph"),
        F.array(F.struct(F.col("url").alias("link"), "title", F.col("para").alias("snippet"), F.array(F.struct(F.concat("url", F.lit("/s")).alias("link"), F.lit("S").alias("title"))).alias("sitelinks")),
                F.struct(F.lit(None).cast("string").alias("link"), F.col("title"), F.col("head").alias("snippet"), F.lit(None).cast("array<struct<link:string,title:string>>").alias("sitelinks"))).alias("organic"))).alias("response"))
    return search_json.hits_a(j)


@query
def search_json_b(spark, sf):
    site = F.struct(F.concat("url", F.lit("/i")).alias("link"), F.lit("I").alias("title"), F.lit("x").alias("snippet"))
    ok = F.to_json(F.struct(F.struct(F.lit("Success").alias("status")).alias("search_metadata"), F.struct(F.col("url").alias("link"), F.lit("A").alias("title"), F.lit("b").alias("snippet")).alias("answer_box"),
                            F.array(F.struct(F.col("url").alias("link"), "title", F.col("head").alias("snippet"), F.struct(F.array(site).alias("inline"), F.array(site).alias("expanded")).alias("sitelinks"))).alias("organic_results")))
    bad = F.lit('{"search_metadata": {"status": "Error"}, "error": "Your account has run out of searches."}')
    empty = F.lit('{"search_metadata": {"status": "Success"}, "error": "Google hasn\'t returned any results for this query."}')
    k = F.col("page_id") % 4
    j = view(spark, sf, "v_page").select(F.col("page_id").alias("query_id"), F.when(k == 1, bad).when(k == 2, empty).otherwise(ok).alias("response"))
    n = search_json.hits_b(j).groupBy("query_id").agg(F.count("*").alias("hits"), F.max("pos").alias("last_pos"), F.min_by("title", "pos").alias("first_title"))
    return search_json.status_b(j).select("query_id", "status").join(n, "query_id", "left")


@query
def search_json_c(spark, sf):
    j = view(spark, sf, "v_page").select(F.col("page_id").alias("query_id"), F.to_json(F.struct(
        F.array(F.struct("url", "title", F.col("para").alias("content"), F.lit("bing").alias("engine"), F.array(F.lit("bing"), F.lit("google")).alias("engines"))).alias("results"),
        F.array(F.array(F.lit("brave"), F.when(F.col("page_id") % 2 == 0, "Suspended: CAPTCHA").otherwise("too many requests"))).alias("unresponsive_engines"))).alias("response"))
    hits, bad = search_json.hits_c(j)
    return (hits.join(bad.select("query_id", F.col("engine").alias("down"), "reason"), "query_id")
            .select("query_id", "href", "title", "snippet", F.array_join("engines", ",").alias("engines"), "down", "reason", health.suspension(F.col("reason")).alias("pause")))


def _result_pages(spark, sf):
    p, k = view(spark, sf, "v_page"), F.col("page_id") % 6
    u, t, s = F.col("url"), T.escape_html(F.col("title")), T.escape_html(F.col("head"))
    body = (F.when(k == 0, Q.fill('<div class="result"><a class="result__a" href="{u}">{t}</a><div class="result__snippet">{s}</div></div><div class="result result--ad"><a class="result__a" href="{u}">ad</a></div>', u=u, t=t, s=s))
            .when(k == 1, Q.fill('<div class="snippet"><a href="{u}"><div class="title">{t}</div></a><div class="generic-snippet">{s}</div></div>', u=u, t=t, s=s))
            .when(k == 2, Q.fill('<div class="g"><a href="{u}"><h3>{t}</h3></a><div class="VwiC3b">{s}</div></div>', u=u, t=t, s=s))
            .when(k == 3, Q.fill("<rss><channel><item><title>{t}</title><link>{u}</link><description>{s}</description></item></channel></rss>", u=T.escape_html(u), t=t, s=s))
            .when(k == 4, F.lit("<p>No results found for this</p>")).otherwise(F.lit('<form id="challenge-form"></form>')))
    layout = F.when(k == 1, "card").when(k == 2, "heading").when(k == 3, "feed").otherwise("list")
    return p.select("page_id", "url", layout.alias("layout"), body.alias("html"))


@query
def result_cards(spark, sf):
    """Saved result pages of every layout, wrapped around the page texts."""
    return markup.result_cards(_result_pages(spark, sf)).select("page_id", "pos", "status", U.result_url(F.col("href")).alias("url"), "title", "snippet")


@query
def result_cards_beside(spark, sf):
    """The same hits by the table function: layout and address of the page stay."""
    found = tables.beside(_result_pages(spark, sf), "result_cards(p.layout, p.html)", "t.pos, t.status, t.href, t.title")
    return found.select("page_id", "layout", "pos", "status", "title", (U.result_url(F.col("href")) == U.result_url(F.col("url"))).alias("same_url"))


@query
def registry_tables(spark, sf):
    """Rows of the registry pages' tables by the table function, company beside."""
    found = tables.beside(view(spark, sf, "v_registry_page"), "registry_cells(p.html)")
    return found.select("page_id", "company_name", "table_no", "section_present", "heading", "row_no", F.array_join("headers", "|").alias("headers"), F.array_join("cells", "|").alias("cells"))


@query
def people_cards(spark, sf):
    """Saved people-search pages, one card per person and page class."""
    p, k = view(spark, sf, "v_person"), F.col("person_id") % 7
    card = Q.fill('<div class="entity-result"><span class="entity-result__title-text"><a href="https://www.profiles.example/in/{a}-{b}/?x=1"><span aria-hidden="true">{f} {l}</span><span class="visually-hidden">View</span></a></span>'
                  '<div class="entity-result__primary-subtitle">{r} at {c}</div><button>Connect</button></div><div class="entity-result"><a href="/in/hidden">Profilenet Member</a></div>',
                  a=F.lower("fn"), b=F.lower("ln"), f=F.col("fn"), l=F.col("ln"), r=F.col("role"), c=F.col("company_name"))
    body = (F.when(k == 1, '<p class="search-no-results">None</p>').when(k == 2, "<p>Too many requests</p>").when(k == 3, '<input name="session_key">').when(k == 4, "<p>Security verification</p>")
            .when(k == 5, "<p>hm</p>").otherwise(card))
    pages = p.select(F.col("person_id").alias("page_id"), F.lit("https://www.profiles.example/search/results/people/").alias("url"), F.when(k == 6, 500).otherwise(200).alias("http_status"),
                     F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
    found = cut_lineage(extract.read_cards(markup.people_cards(pages)))  # read twice below; pages are parsed once
    people = extract.card_people(found)
    return (extract.people_page_class(pages, found).join(people.select("page_id", F.col("url").alias("profile_url"), "name", "headline", "designation"), "page_id", "left"))


@query
def workspace_cards(spark, sf):
    """The same people in the layout with generated class names: whole cards, cards
    whose name leads elsewhere, mixed evidence, shells, members without a name."""
    p, k = view(spark, sf, "v_person"), F.col("person_id") % 6
    parts = dict(a=F.lower("fn"), b=F.lower("ln"), f=F.col("fn"), l=F.col("ln"), r=F.col("role"), c=F.col("company_name"))
    whole = '<div role="listitem"><a href="/in/{a}-{b}/"></a><div><p><a href="/in/%s/?x=1">%s</a> · 2nd</p><div><p>{r} at {c}</p></div><div><p>Current: {r}<br>Past: Analyst</p></div>%s</div><button>Connect</button></div>'
    body = (F.when(k == 1, Q.fill(whole % ("somebody-else", "{f} {l}", ""), **parts))
            .when(k == 2, Q.fill(whole % ("{a}-{b}", "{f} {l}", '<p><a href="/in/somebody-else">Else</a></p>'), **parts))
            .when(k == 3, Q.fill(whole % ("{a}-{b}", "", ""), **parts)).when(k == 4, F.lit(f'<div role="listitem"><p>{vocab.PROFILE_NAME} Member</p></div>'))
            .otherwise(Q.fill(whole % ("{a}-{b}", "{f} {l}", "") + '<div role="listitem"><p>advert</p></div>', **parts)))
    html = F.concat(F.lit('<main id="workspace"><p><a href="/in/own-account">Own Account</a></p><div data-testid="lazy-column"><div role="list">'), body,
                    F.lit('</div></div><div role="list"><div role="listitem"><p><a href="/in/other">Other</a></p></div></div></main>'))
    pages = p.select(F.col("person_id").alias("page_id"), F.lit("https://www.profiles.example/search/results/people/").alias("url"), F.lit(200).alias("http_status"), html.alias("html"))
    read = cut_lineage(extract.read_cards(markup.people_cards(pages)))  # read twice below; pages are parsed once
    people = extract.card_people(read).select("page_id", F.col("url").alias("profile_url"), "name", "headline", "designation", "snippet")
    return extract.people_page_class(pages, read).join(people, "page_id", "left")


# --- result rows -----------------------------------------------------------------------------------------------
@query
def source_priority(spark, sf):
    r = view(spark, sf, "v_row").where(F.col("person_name").isNotNull()).select(
        "company_id", P.name_key(F.col("person_name")).alias("name_key"), (F.col("pos") % 4).cast("int").alias("source_rank"), "pos", "person_name", "designation")
    return rows.first_source(r)


def _row_sides(spark, sf):
    r = view(spark, sf, "v_row").select("company_id", "pos", *rows.ROW_FIELDS)
    site = r.where(F.coalesce("source", F.lit("")) != vocab.REGISTRY_SOURCE).where(F.col("person_name").isNotNull())
    own = site.withColumn("k", P.name_key(F.col("person_name")))
    keep = [c for c in site.columns]
    return results.first_seen(own, ("company_id", "k")).select(*keep), r.where(F.col("source") == vocab.REGISTRY_SOURCE)


@query
def source_merge_rows(spark, sf):
    site, reg = _row_sides(spark, sf)
    return rows.merge_director_rows(site, reg).drop("late")


@query
def fallback_cascade(spark, sf):
    r = view(spark, sf, "v_row").withColumn("name_key", P.name_key(F.col("person_name")))
    people = (r.where(F.col("person_name").isNotNull()).select(
        "company_id", "name_key", (F.col("pos") % 3).cast("int").alias("source_rank"), "pos", F.col("person_name").alias("name"),
        F.when(F.col("pos") % 5 > 0, F.col("designation")).alias("role"), (F.col("pos") % 9).alias("score"), F.when(F.col("pos") % 13 == 0, F.col("profile_url")).alias("profile_url")))
    leaders = rows.rank_people(rows.website_leaders(people))
    lookups = rows.first_source(people).select("company_id", "name_key", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("https://in.profiles.example/in/"), "name_key")).alias("url"),
                            F.when(F.col("pos") % 17 == 0, "captcha").alias("outage"), (F.col("pos") % 34 == 0).alias("blocking"))
    companies = view(spark, sf, "v_row").select("company_id").distinct()
    have_site = companies.where(F.col("company_id") % 4 > 0)
    _, reg = _row_sides(spark, sf)
    return rows.resolve_companies(companies, have_site, leaders, lookups, reg)


@query
def cascade_outages(spark, sf):
    """C4 / C6 with searches that were down: rows without a person say which one.
    Few people come from the site itself, so that titles and snippets are asked."""
    r = cut_lineage(view(spark, sf, "v_row").withColumn("name_key", P.name_key(F.col("person_name"))))
    has_site = F.col("company_id") % 4 > 0
    rank = F.when((F.col("pos") % 23 == 0) & has_site, 0).when(F.col("pos") % 23 < 2, 1).otherwise(2)
    people = r.where(F.col("person_name").isNotNull()).select(
        "company_id", "name_key", rank.alias("source_rank"), "pos", F.col("person_name").alias("name"), F.when(F.col("pos") % 5 > 0, F.col("designation")).alias("role"),
        (F.col("pos") % 9).alias("score"), F.when(F.col("pos") % 13 == 0, F.col("profile_url")).alias("profile_url"))
    companies = r.select("company_id").distinct()
    step = F.element_at(F.array(*[F.lit(x) for x in rows.STEPS]), (F.col("pos") % 3 + 1).cast("int"))
    outages = r.where(F.col("person_name").isNull() & F.col("status").isin("search_unavailable", "other")).select(
        "company_id", step.alias("step"), F.concat(step, F.lit(" limited")).alias("reason"), (F.col("pos") % 2 == 0).alias("blocking"))
    down = cut_lineage(rows.search_outages(companies, people, outages))
    limited = F.col("pos") % 17 == 0
    lookups = rows.first_source(people).select(
        "company_id", "name_key", F.when((F.col("pos") % 2 == 0) & ~limited, F.concat(F.lit("https://in.profiles.example/in/"), "name_key")).alias("url"),
        F.when(limited, "captcha").alias("outage"), (F.col("pos") % 34 == 0).alias("blocking"))
    told = r.where((F.col("source") == vocab.REGISTRY_SOURCE) & (F.col("status").isin("profile_unverified") | F.col("person_name").isNull()))
    told = told.withColumns({"person_name": F.concat("person_name", F.lit(" Senior")), "profile_url": F.lit(None).cast("string")})
    named = results.first_seen(told.where(F.col("person_name").isNotNull()), ("company_id", "name_key"))
    cols = ["company_id", "pos", *rows.ROW_FIELDS]
    reg = named.select(*cols).unionByName(told.where(F.col("person_name").isNull()).select(*cols))
    out = rows.resolve_companies(companies, companies.where(has_site), rows.rank_people(rows.website_leaders(people, down)), lookups, reg, down)
    return out.select("company_id", "pos", "person_name", "designation", "profile_url", "status", "source", "reason")


@query
def direct_cascade(spark, sf):
    companies = view(spark, sf, "v_person").select("company_id", "company_name").distinct()
    k = F.col("company_id") % 4
    base = (view(spark, sf, "v_person").withColumn("name", F.concat_ws(" ", "fn", "ln")).withColumn("name_key", P.name_key(F.col("name"))).withColumn("pos", F.col("person_id")))
    supplied = base.where(k == 0).select("company_id", "name_key", "pos", "name", "role")
    found = extract.leader_from_profile(view(spark, sf, "v_title_hit").where(k == 1).withColumn("headline", F.lit("")).withColumn("card_name", F.lit(""))).withColumn("name_key", P.name_key(F.col("name")))
    fallback = base.where(k > 1).where(k == 2).select("company_id", "name_key", (F.col("pos") % 2).cast("int").alias("source_rank"), "pos", "name", "role",
                                       F.when(F.col("pos") % 2 == 0, vocab.REGISTRY_SOURCE).otherwise(vocab.METASEARCH_SOURCE).alias("source"))
    return rows.resolve_direct(companies, supplied, found, fallback, _direct_lookups(base))


def _direct_lookups(base):
    return base.select("company_id", "name_key", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("https://in.profiles.example/in/"), "name_key")).alias("url"),
                       F.when(F.col("pos") % 7 == 1, "limited").alias("outage"), F.lit(True).alias("blocking")).groupBy("company_id", "name_key").agg(
        F.max("url").alias("url"), F.max("outage").alias("outage"), F.max("blocking").alias("blocking"))


def _direct_sources(spark, sf):
    """Supplied, found and fallback people of every company, less what the nation
    of its people says: the input list names those of nations 0 and 1, and a
    company with people of nations 23 and 24 has no search hits.  Headline and
    card name come from the saved people-search cards."""
    base = view(spark, sf, "v_person").withColumn("name", F.concat_ws(" ", "fn", "ln")).withColumn("name_key", P.name_key(F.col("name"))).withColumn("pos", F.col("person_id"))
    supplied = base.where(F.col("c_nationkey") < 2).select("company_id", "name_key", "pos", "name", "role")
    cards = (people_cards(spark, sf).where(F.col("profile_url").isNotNull()).join(base.select("company_id", F.col("person_id").alias("page_id")), "page_id")
             .select("company_id", U.profile_slug(F.col("profile_url")).alias("slug"), "headline", F.col("name").alias("card_name")))
    hits = view(spark, sf, "v_title_hit").join(base.where(F.col("c_nationkey") > 22).select("company_id"), "company_id", "left_anti")
    hits = hits.withColumn("slug", U.profile_slug(F.col("url"))).join(cards, ["company_id", "slug"], "left").drop("slug")
    found = extract.leader_from_profile(hits.withColumns({c: F.coalesce(c, F.lit("")) for c in ("headline", "card_name")})).withColumn("name_key", P.name_key(F.col("name")))
    fallback = base.select("company_id", "name_key", (F.col("pos") % 2).cast("int").alias("source_rank"), "pos", "name", "role",
                           F.when(F.col("pos") % 2 == 0, vocab.REGISTRY_SOURCE).otherwise(vocab.METASEARCH_SOURCE).alias("source"))
    return base, supplied, found, fallback


@query
def direct_cascade_whole(spark, sf):
    """C5 with all sources of all companies, so that they compete."""
    base, supplied, found, fallback = _direct_sources(spark, sf)
    return rows.resolve_direct(base.select("company_id", "company_name").distinct(), supplied, found, fallback, _direct_lookups(base))


@query
def report_rows(spark, sf):
    return report.report_rows(view(spark, sf, "v_row"))


@query
def report_workbooks(spark, sf):
    """The report written as workbooks and read back, cell by cell."""
    path = shared_folder(spark, "report")
    report.write_report(view(spark, sf, "v_row"), path, "workbooks")
    found = sheets.read_workbooks(spark, path).where("row_no > 1")
    names = ["company_name", "person_name", "designation", "profile_url", "source", "status", "din", "appointment_date", "source_url", "reason"]
    cell = [F.coalesce(F.max(F.when(F.col("col_no") == i + 1, F.col("value"))), F.lit("")).alias(n) for i, n in enumerate(names)]
    return found.groupBy("file", "row_no").agg(*cell).drop("file", "row_no")


@query
def report_as_input(spark, sf):
    """Exported reports as the next run's input lists: each file by its own header."""
    path = shared_folder(spark, "report")
    report.write_report(view(spark, sf, "v_row"), path, "workbooks")
    return cells.sheet_rows(sheets.read_workbooks(spark, path), "file").select("company", "person", "role")


@query
def report_summary(spark, sf):
    return report.summary(view(spark, sf, "v_row"))


# --- sources over time --------------------------------------------------------------------------------------------
@query
def engine_cooldown(spark, sf):
    e = health.engine_events(view(spark, sf, "v_health")).select("engine", "ts", "event_id", "cool", "is_empty")
    return health.paused_timeline(e, ["engine"], limit=vocab.EMPTY_STREAK_LIMIT).select("event_id", "engine", "skipped", "streak")


@query
def source_cooldown(spark, sf):
    e = health.source_events(view(spark, sf, "v_health")).select("instance", "engine", "ts", "event_id", "cool", "is_empty")
    return health.paused_timeline(e, ["instance", "engine"]).select("event_id", "instance", "engine", "skipped")


@query
def engine_suspension(spark, sf):
    e = health.source_events(view(spark, sf, "v_health"), health.suspension).select("engine", "ts", "event_id", "cool", "is_empty")
    return health.paused_timeline(e, ["engine"]).groupBy("engine").agg(F.count_if("skipped").alias("skipped"), F.count("*").alias("events"))


@query
def health_snapshot(spark, sf):
    e = health.source_events(view(spark, sf, "v_health")).select("engine", "ts", "event_id", "cool", "is_empty", "outcome")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp").cast("double")
    return health.health_snapshot(health.paused_timeline(e, ["engine"]), ["engine"], now).select("engine", "status", F.col("last_success").cast("timestamp_ntz").alias("last_success"))


@query
def cache_ttl(spark, sf):
    e = health.cache_events(view(spark, sf, "v_health")).select(F.col("engine").alias("cache_key"), "ts", "event_id", "cool", "is_empty")
    return health.paused_timeline(e, ["cache_key"], longest=float(vocab.CACHE_TTL)).select("event_id", "cache_key", F.col("skipped").alias("hit"))


@query
def warn_once(spark, sf):
    e = view(spark, sf, "v_health").where(F.col("reason").isNotNull()).withColumnRenamed("instance", "job_id")
    return arrivals.warn_once(e).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def run_sets(spark, sf):
    e = view(spark, sf, "v_health").select("instance", F.col("engine").cast("string").alias("provider"), F.col("reason").alias("warning"))
    s = results.run_sets(e, ("instance",))
    return s.select("instance", F.array_join("providers", ",").alias("providers"), F.array_join("warnings", ",").alias("warnings"))


@query
def first_accepted_cutoff(spark, sf):
    a = arrivals.after_head_start(view(spark, sf, "v_arrival"), "searxng", 60.0)
    return arrivals.first_acceptable(a, 900.0).select("query_id", "event_id", "source", "accepted")


@query
def missing_sources(spark, sf):
    a = view(spark, sf, "v_arrival")
    expected = a.select("query_id", "source").distinct()
    return arrivals.missing_sources(expected, arrivals.first_acceptable(a, 600.0))


@query
def job_state(spark, sf):
    return jobs.job_state(view(spark, sf, "v_job_event"))


@query
def job_log_tail(spark, sf):
    return jobs.log_tail(view(spark, sf, "v_job_event"), 5).select("job_id", "event_id", "back")


@query
def job_event_payloads(spark, sf):
    """Job events as JSON payloads, some broken, read as VARIANT and folded."""
    e = view(spark, sf, "v_job_event")
    whole = F.to_json(F.struct("type", "status", "done", "total", "person", "url", F.lit("line").alias("message")))
    raw = e.select("job_id", "ts", "event_id", F.when(F.col("event_id") % 11 == 0, F.lit('{"type":')).when(F.col("event_id") % 11 == 1, F.lit('{"type": "progress", "done": "many"}')).otherwise(whole).alias("payload"))
    return jobs.job_state(jobs.read_events(raw))


@query
def partial_run(spark, sf):
    e = view(spark, sf, "v_job_event")
    cancels = e.where(F.col("status") == "cancelled").select("job_id", "ts")
    return jobs.partial_rows(e.where(F.col("type") == "row"), cancels).select("job_id", "event_id")
