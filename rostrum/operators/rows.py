"""Result rows: source priority, merging, fallbacks and statuses."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import people as P
from rostrum.functions import urls as U
from rostrum.operators.components import components
from rostrum.session import cut_lineage

ROW_FIELDS = ["person_name", "designation", "profile_url", "status", "source", "din", "appointment_date", "source_url", "reason"]


# --- people of several sources ------------------------------------------------------
def first_source(people: DataFrame) -> DataFrame:
    """E3: per company and person the row of the best-ranked source
    ``(company_id, name_key, source_rank, pos, ...)``."""
    rest = [c for c in people.columns if c not in ("company_id", "name_key")]
    return (people.where(F.col("name_key") != "").groupBy("company_id", "name_key")
            .agg(F.min_by(F.struct(*rest), F.struct("source_rank", "pos")).alias("f")).select("company_id", "name_key", "f.*"))


def add_unseen(people: DataFrame, extra: DataFrame) -> DataFrame:
    """J5: people of a lower-priority source that are not known yet."""
    fresh = extra.where(F.col("name_key") != "").join(people.select("company_id", "name_key"), ["company_id", "name_key"], "left_anti")
    return people.unionByName(fresh, allowMissingColumns=True)


def rank_people(people: DataFrame, keep: int = vocab.MAX_PEOPLE) -> DataFrame:
    """W4. Known address first, then stated role, then score."""
    has_url = F.coalesce(F.col("profile_url"), F.lit("")) != ""
    w = Window.partitionBy("company_id").orderBy(
        has_url.desc(), (F.coalesce(F.col("role"), F.lit("")) != "").desc(), F.coalesce("score", F.lit(0)).desc(), "source_rank", "pos")
    return people.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


# --- statuses -------------------------------------------------------------------------
def person_status(url: Column, confidence: Column, outage: Column, unmatched: str = "no_profile") -> Column:
    """C1. ``unmatched`` is ``profile_unverified`` for registry people."""
    found = F.coalesce(url, F.lit("")) != ""
    return (F.when(found & (confidence == "medium"), "ok_medium").when(found, "ok")
            .when(outage.isNotNull(), "search_unavailable").otherwise(unmatched))


def registry_status(reason: Column) -> Column:
    """C2, first rule that fits."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    return (F.when(r.contains("page not found"), "zauba_not_found")
            .when(r.contains("confidence too low"), "zauba_low_confidence")
            .when(r.contains("directors unavailable"), "zauba_no_directors")
            .when(r.contains("could not be loaded"), "zauba_unreachable").otherwise("zauba_error"))


def spread_outages(rows: DataFrame) -> DataFrame:
    """C6 on ``(company_id, person_pos, url, outage, blocking)``.

    A blocking outage ends the lookups of its company: later people carry its
    reason and no address.  A partial one marks its own row only.  The first
    blocking row per company is an aggregate, so no window orders a company.
    """
    first = (rows.where(F.col("blocking") & F.col("outage").isNotNull()).groupBy("company_id")
             .agg(F.min(F.struct("person_pos", "outage")).alias("stop")))
    later = F.coalesce(F.col("person_pos") > F.col("stop.person_pos"), F.lit(False))
    known = F.col("known_url") if "known_url" in rows.columns else F.lit(None).cast("string")
    return (rows.join(first, "company_id", "left")
            .withColumn("url", F.coalesce(known, F.when(~later, F.col("url"))))
            .withColumn("outage", F.when(F.col("url").isNull(), F.when(later, F.col("stop.outage")).otherwise(F.col("outage"))))
            .withColumn("stopped", F.col("stop").isNotNull()).drop("stop"))


def null_rows(companies: DataFrame, rows: DataFrame, status: str, source: str = vocab.WEBSITE_SOURCE, reason: str | None = None) -> DataFrame:
    """C3. One explained row for every company without any."""
    blank = {c: F.lit(None).cast("string") for c in ROW_FIELDS}
    blank.update(status=F.lit(status), source=F.lit(source), reason=F.lit(reason).cast("string"))
    return (companies.select("company_id").join(rows.select("company_id").distinct(), "company_id", "left_anti")
            .select("company_id", F.lit(0).cast("bigint").alias("pos"), *[blank[c].alias(c) for c in ROW_FIELDS]))


def registry_people_rows(officers: DataFrame, outcome: DataFrame, lookups: DataFrame) -> DataFrame:
    """Registry people as result rows: C7's officers and outcome, M6's lookups
    ``(company_id, name_key, url, confidence, outage, blocking)``, C1 and C6.

    Each officer is a row with the status of the lookup, ``profile_unverified``
    where nothing fits; a company without officers is one row with the status of
    its reason (C2), or ``search_unavailable`` where the outcome says so.  The
    row's source and address are the officer's own where it has them (indexed
    results), else the registry page's section.
    """
    named = officers.withColumn("name_key", P.name_key(F.col("person_name"))).join(lookups, ["company_id", "name_key"], "left")
    looked = spread_outages(named.withColumn("person_pos", F.col("pos")).withColumn("blocking", F.coalesce("blocking", F.lit(False))))
    unavailable = F.coalesce("unavailable", F.lit(False)) if "unavailable" in outcome.columns else F.lit(False)
    page = outcome.select("company_id", U.registry_source_url(F.col("page_url")).alias("page"), "reason", "ok", unavailable.alias("unavailable"))

    def text(name: str) -> Column:
        return (F.col(name) if name in officers.columns else F.lit(None).cast("string")).alias(name)

    people = looked.join(page.select("company_id", "page"), "company_id", "left").select(
        "company_id", F.col("pos").cast("bigint").alias("pos"), "person_name", F.coalesce(F.nullif("designation", F.lit("")), F.lit("Director")).alias("designation"),
        F.nullif("url", F.lit("")).alias("profile_url"), person_status(F.col("url"), F.coalesce("confidence", F.lit("")), F.col("outage"), "profile_unverified").alias("status"),
        F.coalesce(text("source"), F.lit(vocab.REGISTRY_SOURCE)).alias("source"), text("din"), text("appointment_date"),
        F.coalesce(F.nullif(text("source_url"), F.lit("")), "page").alias("source_url"), F.col("outage").alias("reason"))
    blank = {c: F.lit(None).cast("string") for c in ROW_FIELDS} | {
        "status": F.when(F.col("unavailable"), "search_unavailable").otherwise(registry_status(F.col("reason"))), "source": F.lit(vocab.REGISTRY_SOURCE), "source_url": F.col("page"), "reason": F.col("reason")}
    missed = page.where(~F.col("ok")).select("company_id", F.lit(0).cast("bigint").alias("pos"), *[v.alias(c) for c, v in blank.items()])
    return people.unionByName(missed)


# --- J4 -----------------------------------------------------------------------------------
def _link_names(people: DataFrame) -> DataFrame:
    """Name keys of a company that are tied together by shared addresses:
    ``(company_id, name_key, person)``, one component of names each.  Every
    address ties its names to the least of them, so a busy address adds as many
    edges as it has names."""
    edges = people.where(F.col("profile_url").isNotNull()).select("company_id", "name_key", "profile_url").distinct()
    low = edges.groupBy("company_id", "profile_url").agg(F.min("name_key").alias("low"), F.count("*").alias("n")).where("n > 1")
    ties = edges.join(low, ["company_id", "profile_url"]).select(
        F.struct("company_id", "name_key").alias("a"), F.struct("company_id", F.col("low").alias("name_key")).alias("b"))
    return components(ties, "a", "b").select("node.company_id", "node.name_key", F.col("label.name_key").alias("person"))


def merge_director_rows(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """J4 + C8. Registry rows join the first row with the same name key or the same
    address, override its fields and may chain into each other; both inputs are
    ``(company_id, pos, *ROW_FIELDS)``.

    Rows can only meet inside a person (names tied by addresses), so the ordered
    fold runs per person and never over a whole company.
    """
    lost = (registry.where(F.col("person_name").isNull() & (F.col("status") == "search_unavailable")).groupBy("company_id")
            .agg(F.min_by(F.struct("reason", "source_url"), "pos").alias("lost")))
    hit = F.col("profile_url").isNull() & F.col("lost").isNotNull()
    base = (rows.join(lost, "company_id", "left")
            .withColumn("status", F.when(hit, "search_unavailable").otherwise(F.col("status")))
            .withColumn("reason", F.when(hit, F.col("lost.reason")).otherwise(F.col("reason")))
            .withColumn("source_url", F.when(hit, F.coalesce("source_url", "lost.source_url")).otherwise(F.col("source_url"))).drop("lost"))
    cols = ["company_id", "pos", *ROW_FIELDS]
    pool = (base.select(*cols, F.lit(0).alias("late")).unionByName(registry.where(F.col("person_name").isNotNull()).select(*cols, F.lit(1).alias("late")))
            .withColumn("profile_url", F.nullif("profile_url", F.lit(""))).withColumn("name_key", P.name_key(F.col("person_name"))))
    # A name without a Latin letter has no key: such rows meet by their address only.
    pool = pool.withColumn("name_key", F.when(F.col("name_key") != "", F.col("name_key")).otherwise(F.concat_ws("#", F.lit(""), "late", "pos")))
    tied = (pool.join(_link_names(pool), ["company_id", "name_key"], "left")
            .withColumn("person", F.coalesce("person", "name_key")))
    item = F.struct("late", "pos", *ROW_FIELDS, "name_key")
    listed = F.array_sort(F.collect_list(item))
    people = tied.groupBy("company_id", "person").agg(listed.alias("all"))

    def fold(acc: Column, reg: Column) -> Column:
        same = F.array_position(F.transform(acc, lambda x: F.coalesce((x["name_key"] == reg["name_key"]) | (x["profile_url"] == reg["profile_url"]), F.lit(False))), F.lit(True))
        return F.when(same == 0, F.concat(acc, F.array(reg))).otherwise(
            F.transform(acc, lambda x, i: F.when(i == same - 1, _override(x, reg)).otherwise(x)))

    merged = F.aggregate(F.filter("all", lambda x: x["late"] == 1), F.filter("all", lambda x: x["late"] == 0), fold)
    return (people.select("company_id", F.explode(merged).alias("r"))
            .select("company_id", F.col("r.late").alias("late"), F.col("r.pos").alias("pos"), *[F.col(f"r.{c}").alias(c) for c in ROW_FIELDS]))


def _override(old: Column, reg: Column) -> Column:
    url = F.coalesce(old["profile_url"], reg["profile_url"])
    down = F.when(reg["status"] == "search_unavailable", reg).when(old["status"] == "search_unavailable", old)
    had = old["profile_url"].isNotNull()
    status = F.when(had, old["status"]).when(url.isNotNull(), reg["status"]).otherwise(F.coalesce(down["status"], reg["status"]))
    reason = F.when(url.isNull(), F.coalesce(down["reason"], reg["reason"], old["reason"]))
    values = {"status": status, "reason": reason, "profile_url": url, "source": F.when(had, old["source"]).otherwise(reg["source"]),
              "din": reg["din"], "appointment_date": reg["appointment_date"], "source_url": reg["source_url"],
              "person_name": reg["person_name"], "designation": reg["designation"]}
    return F.struct(old["late"].alias("late"), old["pos"].alias("pos"), *[values[c].alias(c) for c in ROW_FIELDS], reg["name_key"].alias("name_key"))


# --- cascades ------------------------------------------------------------------------------
#: Searches of the main cascade that can be down.
STEPS = ("site", "titles", "snippets")


def _down(outages: DataFrame) -> DataFrame:
    """One row per company: ``<step>`` holds (reason, blocking) of each step that
    was down; of repeated ones a blocking one counts, then the least reason."""
    what = F.struct((~F.coalesce("blocking", F.lit(False))).alias("passing"), F.coalesce("reason", F.lit("")).alias("reason"))
    return outages.where(F.col("company_id").isNotNull()).groupBy("company_id").agg(
        *[F.min(F.when(F.col("step") == step, what)).alias(step) for step in STEPS])


def search_outages(companies: DataFrame, pool: DataFrame, outages: DataFrame) -> DataFrame:
    """C4 / C6: what the outages ``(company_id, step, reason, blocking)`` of the
    searches for people leave behind: ``(company_id, site_reason, reason,
    blocking, no_titles, no_snippets)`` for companies that had any.

    A search counts only where the cascade asks it: titles below two titled
    people of the site, snippets where nobody is titled and titles were not
    blocked.  The later outage stands.  An outage of the site search is passed on
    as ``site_reason``.
    """
    down = companies.select("company_id").join(_down(outages), "company_id")
    own = first_source(pool).join(down.select("company_id"), "company_id", "left_semi")
    titled = F.coalesce(F.col("role"), F.lit("")) != ""
    n = own.groupBy("company_id").agg(*[F.count_if(titled & (F.col("source_rank") == i)).alias(f"n{i}") for i in range(2)])
    n0, n1 = (F.coalesce(f"n{i}", F.lit(0)) for i in range(2))
    no_titles = (n0 < 2) & F.col("titles").isNotNull()
    stopped = no_titles & ~F.coalesce("titles.passing", F.lit(False))
    asked = (n0 == 0) & (F.col("titles").isNotNull() | (n1 == 0)) & ~stopped
    no_snippets = asked & F.col("snippets").isNotNull()
    last = F.when(no_snippets, F.col("snippets")).when(no_titles, F.col("titles"))
    return (down.join(n, "company_id", "left").withColumn("last", last)
            .select("company_id", F.col("site.reason").alias("site_reason"), F.col("last.reason").alias("reason"),
                    F.coalesce(~F.col("last.passing"), F.lit(False)).alias("blocking"), no_titles.alias("no_titles"), (no_snippets | stopped).alias("no_snippets")))


def website_leaders(pool: DataFrame, outages: DataFrame | None = None) -> DataFrame:
    """C4, people half, over ``(company_id, name_key, source_rank, pos, role, ...)``
    with ranks 0 = crawled, 1 = result titles, 2 = snippets.

    Titles top up companies with fewer than two titled people, snippets those
    with none; untitled people go once any is titled.  Snippets are only read
    where titles are, so one row per person can be chosen before the counts.
    People of a search that :func:`search_outages` reports as down do not exist.
    """
    if outages is not None:
        pool = (pool.join(outages.select("company_id", "no_titles", "no_snippets"), "company_id", "left")
                .where(~((F.col("source_rank") == 1) & F.coalesce("no_titles", F.lit(False))) & ~((F.col("source_rank") == 2) & F.coalesce("no_snippets", F.lit(False))))
                .drop("no_titles", "no_snippets"))
    people = first_source(pool)
    titled = F.coalesce(F.col("role"), F.lit("")) != ""
    n = people.groupBy("company_id").agg(*[F.count_if(titled & (F.col("source_rank") == i)).alias(f"n{i}") for i in range(3)])
    with_1 = F.col("n0") < 2
    with_2 = with_1 & (F.col("n0") + F.col("n1") == 0)
    used = F.col("n0") + F.when(with_1, F.col("n1")).otherwise(0) + F.when(with_2, F.col("n2")).otherwise(0)
    read = (F.col("source_rank") == 0) | ((F.col("source_rank") == 1) & with_1) | ((F.col("source_rank") == 2) & with_2)
    return people.join(n, "company_id").where(read & (titled | (used == 0))).drop("n0", "n1", "n2")


def resolve_companies(companies: DataFrame, sites: DataFrame, leaders: DataFrame, lookups: DataFrame, registry: DataFrame,
                      outages: DataFrame | None = None) -> DataFrame:
    """C4. ``leaders``: W4 output with ``profile_url``; ``lookups(company_id,
    name_key, url, outage, blocking)``; ``registry``: result rows of the registry
    (``person_name`` NULL = explained miss).

    No site and the registry names someone (or is down): its rows stand.
    No people at all: its rows, whatever they say.  People, some without an
    address: rows merged with the registry's.  Otherwise the rows as found.

    ``outages``: what :func:`search_outages` returns.  A site search that was down
    counts where there is no site: the registry's answer stands, else one
    ``search_unavailable`` row; nobody else is looked for.  A blocking outage of
    the people searches ends lookups and registry alike: known addresses stay,
    the others carry its reason; without people it is the answer.  A passing one
    is the answer only where neither people nor the registry gave one.
    """
    if outages is not None:
        down = outages.select("company_id", "site_reason", F.col("reason").alias("late_reason"), F.coalesce("blocking", F.lit(False)).alias("late_blocking"))
        shut = down.where("site_reason is not null").join(sites.select("company_id"), "company_id", "left_anti")
        leaders = leaders.join(shut.select("company_id"), "company_id", "left_anti")
    # the looked-up people feed several branches: keep them once
    people = cut_lineage(leaders.join(lookups, ["company_id", "name_key"], "left")
                         .withColumn("person_pos", F.col("rank")).withColumn("known_url", F.nullif("profile_url", F.lit("")))
                         # nobody looks for a person whose address is known
                         .withColumn("outage", F.when(F.col("known_url").isNull(), F.col("outage")))
                         .withColumn("blocking", F.coalesce("blocking", F.lit(False))))
    has_site = sites.select("company_id", F.lit(True).alias("has_site")).distinct()
    answered = registry.groupBy("company_id").agg(F.max(F.col("person_name").isNotNull() | (F.col("status") == "search_unavailable")).alias("answered"))
    looked = spread_outages(people)
    if outages is not None:
        ended = F.coalesce("late_blocking", F.lit(False))
        looked = (looked.join(down.select("company_id", "late_reason", "late_blocking"), "company_id", "left")
                  .withColumn("url", F.when(ended, F.col("known_url")).otherwise(F.col("url")))
                  .withColumn("outage", F.when(F.col("url").isNull(), F.when(ended, F.col("late_reason")).otherwise(F.col("outage"))))
                  .withColumn("stopped", F.col("stopped") | ended).drop("late_reason", "late_blocking"))
    state = looked.groupBy("company_id").agg(F.max(F.col("url").isNull()).alias("open"), F.max("stopped").alias("stopped"))
    plan = (companies.select("company_id").join(has_site, "company_id", "left").join(answered, "company_id", "left").join(state, "company_id", "left"))
    way = (F.when((F.col("has_site").isNull() & F.coalesce("answered", F.lit(False))) | F.col("open").isNull(), "registry")
           .when(F.col("open") & ~F.col("stopped"), "merge").otherwise("rows"))
    said = F.lit(None).cast("string")
    if outages is not None:
        plan = plan.join(down, "company_id", "left")
        unanswered = ~F.coalesce("answered", F.lit(False))
        shut = F.col("has_site").isNull() & F.col("site_reason").isNotNull() & unanswered
        nobody = F.col("open").isNull() & F.col("late_reason").isNotNull() & (F.col("late_blocking") | unanswered)
        gone = F.col("has_site").isNull() & ~unanswered
        way = F.when(shut, "site down").when(nobody & ~gone, "search down").otherwise(way)
        said = F.when(shut, F.col("site_reason")).when(nobody, F.col("late_reason"))
    plan = cut_lineage(plan.select("company_id", way.alias("way"), said.alias("said")))
    rows = looked.join(plan.where("way in ('merge', 'rows')").select("company_id", "way"), "company_id").select(
        "company_id", F.col("rank").cast("bigint").alias("pos"), F.col("name").alias("person_name"),
        F.coalesce(F.nullif("role", F.lit("")), F.lit("Director")).alias("designation"), F.col("url").alias("profile_url"),
        person_status(F.col("url"), F.lit(""), F.col("outage")).alias("status"), F.lit(vocab.WEBSITE_SOURCE).alias("source"),
        *[F.lit(None).cast("string").alias(c) for c in ("din", "appointment_date", "source_url")], F.col("outage").alias("reason"), "way")
    reg = registry.join(plan.select("company_id", "way"), "company_id").select("company_id", "pos", *ROW_FIELDS, "way")
    merged = merge_director_rows(rows.where("way = 'merge'").drop("way"), reg.where("way = 'merge'").drop("way")).drop("late")
    out = merged.unionByName(rows.where("way = 'rows'").drop("way")).unionByName(reg.where("way = 'registry'").drop("way"))
    silent = plan.where("way = 'registry'").join(registry.select("company_id").distinct(), "company_id", "left_anti")
    out = out.unionByName(null_rows(silent, registry.where(F.lit(False)), "error"))
    if outages is None:
        return out
    blank = {c: F.lit(None).cast("string") for c in ROW_FIELDS} | {
        "status": F.lit("search_unavailable"), "source": F.when(F.col("way") == "site down", vocab.REGISTRY_SOURCE).otherwise(vocab.WEBSITE_SOURCE), "reason": F.col("said")}
    return out.unionByName(plan.where("way in ('site down', 'search down')").select("company_id", F.lit(0).cast("bigint").alias("pos"), *[v.alias(c) for c, v in blank.items()]))


def resolve_direct(companies: DataFrame, supplied: DataFrame, found: DataFrame, fallback: DataFrame, lookups: DataFrame) -> DataFrame:
    """C5. Supplied names; else people found on profiles (X5 rows with ``url``);
    else registry names, else snippet names (``source_rank``), at most eight."""
    def without(df: DataFrame, known: DataFrame) -> DataFrame:
        return df.join(known.select("company_id").distinct(), "company_id", "left_anti")

    own = without(first_source(found.withColumn("source_rank", F.lit(0))), supplied)
    rest = without(without(fallback, supplied), own)
    best = rest.groupBy("company_id").agg(F.min("source_rank").alias("source_rank"))
    w = Window.partitionBy("company_id").orderBy("pos")
    rest = (first_source(rest.join(best, ["company_id", "source_rank"], "left_semi"))
            .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= vocab.MAX_PEOPLE).drop("_n"))
    cols = ["company_id", "name_key", "pos", "name", "role", "source"]
    asked = (supplied.withColumn("source", F.lit(None).cast("string")).select(*cols).unionByName(rest.select(*cols))
             .join(lookups, ["company_id", "name_key"], "left").withColumn("person_pos", F.col("pos"))
             .withColumn("blocking", F.coalesce("blocking", F.lit(False))))
    looked = spread_outages(asked).select(
        "company_id", "pos", F.col("name").alias("person_name"), F.col("role").alias("designation"), F.col("url").alias("profile_url"),
        person_status(F.col("url"), F.lit(""), F.col("outage")).alias("status"), F.coalesce("source", F.lit(vocab.PROFILE_SOURCE)).alias("source"),
        F.col("outage").alias("reason"))
    seen = own.select("company_id", "pos", F.col("name").alias("person_name"), F.col("role").alias("designation"), F.col("url").alias("profile_url"),
                      F.lit("ok").alias("status"), F.lit(vocab.PROFILE_SOURCE).alias("source"), F.lit(None).cast("string").alias("reason"))
    out = looked.unionByName(seen)
    miss = null_rows(companies, out, "profile_unverified", vocab.PROFILE_SOURCE, "No source names a person of this company; "
                     "list known people in the input to search for them.").select(*out.columns)
    return out.unionByName(miss)
