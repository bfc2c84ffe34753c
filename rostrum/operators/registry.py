"""Company -> registry record -> current officers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import match as M
from rostrum.functions import text as T
from rostrum.functions import urls as U
from rostrum.operators.results import first_seen
from rostrum.session import cut_lineage


def registry_candidates(results: DataFrame) -> DataFrame:
    """U11 + W8 on ``(company_id, pos, url, title)``: one candidate per registry id.
    Rows are dealt out by company before the work on them, for all that follows."""
    results = results.repartition("company_id")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?i)\s*[|-]\s*Zauba.*$", ""))
    rows = (T.once(results, rec=U.registry_record(F.col("url"))).where(F.col("rec").isNotNull())
            .select("company_id", F.col("rec.cin").alias("cin"), "pos", F.col("rec.url").alias("url"),
                    F.when(F.length(title) >= 4, title).otherwise(F.col("rec.name")).alias("candidate_name"),
                    F.col("rec.name").alias("alt_name")))
    return first_seen(rows, ("company_id", "cin"))


def name_match(name: Column, words: Column) -> Column:
    """M3 + M4 of a company, given as its comparable words, and a printed name."""
    return M.name_verdict(M.name_similarity(words, T.comparable_tokens(name)))


def match_candidates(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """J2 + M3 + M4: every candidate with the better of its two verdicts, by its
    printed name and by its address.

    All work on a candidate is done where its company's rows lie: a name is judged
    in the first of the company's rows that carry it, which the others read, so
    rows are dealt out once and joined to nothing but their company."""
    wanted = companies.select("company_id", "company_name", T.comparable_tokens(F.col("company_name")).alias("_want"))
    rows = candidates.join(wanted, "company_id")
    for name, verdict in (("candidate_name", "by_name"), ("alt_name", "by_slug")):
        alike = Window.partitionBy("company_id", "company_name", name)
        rows = rows.withColumn("_nth", F.row_number().over(alike.orderBy("company_id")))
        judged = F.when((F.col("_nth") == 1) & F.col("company_name").isNotNull() & F.col(name).isNotNull(), name_match(F.col(name), F.col("_want")))
        rows = T.once(rows, _first=judged).withColumn(verdict, F.first("_first", ignorenulls=True).over(alike)).drop("_first", "_nth")
    best = F.when(F.col("by_name").isNull() | (F.col("by_slug.score") > F.col("by_name.score")), F.col("by_slug")).otherwise(F.col("by_name"))
    return rows.select(*candidates.columns, "company_name", best.alias("match"))


def _best(matched: Column | None = None) -> Column:
    """W2 as an aggregate over matched candidates, or those that ``matched`` picks."""
    fits = F.col("match.accepted") if matched is None else F.col("match.accepted") & matched
    row = F.struct("cin", "pos", "url", "candidate_name", "alt_name", "match.score", "match.confidence")
    return F.max_by(F.when(fits, row), F.when(fits, F.struct("match.score", (-F.col("pos")).alias("p"))))


def best_candidate(matched: DataFrame) -> DataFrame:
    """W2. Highest accepted score, earliest on ties."""
    return matched.where("match.accepted").groupBy("company_id").agg(_best().alias("b")).select("company_id", "b.*")


def _known(web: DataFrame, site: DataFrame, pages: DataFrame, outages: DataFrame | None) -> DataFrame:
    """One row for each company of which any table knows something: its best
    candidate, whether it has any, its page's section and what was down.  All
    tables are put below each other and grouped once."""
    told = (web.withColumn("search", F.lit("web")).unionByName(site.withColumn("search", F.lit("site")))
            .select("company_id", "search", "cin", "pos", "url", "candidate_name", "alt_name", "match")
            .unionByName(pages.select("company_id", "section_present"), allowMissingColumns=True))
    if outages is not None:
        told = told.unionByName(outages.where(F.col("company_id").isNotNull()).select("company_id", "step", F.coalesce("message", F.lit("")).alias("said")),
                                allowMissingColumns=True)

    def down(step: str) -> Column:
        return F.min(F.when(F.col("step") == step, F.col("said"))) if outages is not None else F.lit(None).cast("string")

    by = {s: F.col("search") == s for s in ("web", "site")}
    known = told.groupBy("company_id").agg(
        *[_best(by[s]).alias(f"best_{s}") for s in by], *[F.coalesce(F.max(by[s]), F.lit(False)).alias(f"any_{s}") for s in by],
        F.max("section_present").alias("section_present"), *[down(step).alias(f"{step}_down") for step in OUTAGE_STEPS])
    up = {s: F.col(f"{s}_down").isNull() for s in by}
    return known.select("company_id", F.coalesce(*[F.when(up[s], F.col(f"best_{s}")) for s in by]).alias("best"),
                        ((up["web"] & F.col("any_web")) | (up["site"] & F.col("any_site"))).alias("any_candidate"),
                        "section_present", *[f"{step}_down" for step in OUTAGE_STEPS])


def registry_outcome(companies: DataFrame, web: DataFrame, site: DataFrame, pages: DataFrame, page_officers: DataFrame,
                     indexed_officers: DataFrame, followup_officers: DataFrame, outages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """C7. Returns ``(officers, outcome)``.

    ``web`` / ``site``: matched candidates from web search and the registry's own
    search; ``pages(company_id, section_present)``: loaded registry pages; the
    three officer tables share ``(company_id, pos, person_name, ...)``.
    A page with a section is final even when it names nobody.

    ``outages(company_id, step, message)`` says which searches were down: ``web``
    (no candidates and no indexed results come from it), ``site`` or ``officers``
    (the follow-up query).  An outage counts only where the cascade asks that
    search; ``unavailable`` marks companies whose answer is missing because of
    one of the web searches.  Of repeated outages of a step the least message counts.

    What is known of a company and its officers are worked out once and kept, as
    both results read them.
    """
    known = cut_lineage(_known(web, site, pages, outages))

    def stage(df: DataFrame, rank: int) -> DataFrame:
        return df.withColumn("stage", F.lit(rank))

    told = (stage(page_officers, 1).unionByName(stage(indexed_officers, 2), allowMissingColumns=True)
            .unionByName(stage(followup_officers, 3), allowMissingColumns=True))
    open_page = ~F.coalesce("section_present", F.lit(False))
    asked = ((F.col("stage") == 1) | (open_page & (((F.col("stage") == 2) & F.col("web_down").isNull())
                                                   | ((F.col("stage") == 3) & F.col("officers_down").isNull()))))
    found = known.where(F.col("best").isNotNull()).select("company_id", "section_present", "web_down", "officers_down")
    pool = told.join(found, "company_id").where(asked).withColumn("_first", F.min("stage").over(Window.partitionBy("company_id")))
    officers = cut_lineage(pool.where(F.col("stage") == F.col("_first")).select("company_id", *[c for c in told.columns if c != "company_id"]))
    outcome = (companies.select("company_id").join(known, "company_id", "left")
               .join(officers.groupBy("company_id").agg(F.min("stage").alias("stage")), "company_id", "left"))
    lost, named = F.col("best").isNull(), F.col("stage").isNotNull()
    web_down, site_down, officers_down = (F.col(f"{step}_down") for step in OUTAGE_STEPS)
    no_site = F.concat(F.lit("ZaubaCorp site search could not be loaded: "), site_down)
    reason = (F.when(lost & web_down.isNotNull(), F.concat_ws("; ", F.concat(F.lit("ZaubaCorp company search could not recover after: "), web_down), no_site))
              .when(lost & site_down.isNotNull(), no_site)
              .when(lost & F.col("any_candidate"), "Company match confidence too low")
              .when(lost, "ZaubaCorp page not found")
              .when(named, "")
              .when(open_page & officers_down.isNotNull(), F.concat(F.lit("ZaubaCorp company matched, but director information could not be recovered: "), officers_down))
              .when(F.col("section_present").isNotNull(), "Directors unavailable")
              .otherwise("ZaubaCorp page could not be loaded; indexed results did not identify directors"))
    unavailable = (lost & web_down.isNotNull()) | (~lost & ~named & open_page & officers_down.isNotNull())
    return officers, outcome.select("company_id", F.concat("best.url", F.lit(f"#{vocab.REGISTRY_SECTION}")).alias("page_url"),
                                    F.col("best.candidate_name").alias("matched_name"),
                                    F.coalesce("best.confidence", F.lit("none")).alias("confidence"),
                                    named.alias("ok"), reason.alias("reason"), unavailable.alias("unavailable"))


#: Searches of the registry cascade that can be down.
OUTAGE_STEPS = ("web", "site", "officers")
