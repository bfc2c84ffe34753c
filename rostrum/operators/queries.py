"""Query tables: ordered templates, one row per variant."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import people as P
from rostrum.functions import text as T


def fill(template: str, **cols: Column) -> Column:
    """``'"{brand}" official website'`` with each name replaced by a Column."""
    cols = {"site": F.lit(vocab.PROFILE_HOST), "net": F.lit(vocab.PROFILE_NAME), "netlow": F.lit(vocab.PROFILE_NAME.lower())} | cols
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if brace:
            name, _, tail = tail.partition("}")
            parts.append(cols[name])
        rest = tail
    return F.concat(*parts)


def explode_variants(df: DataFrame, kind: str, templates: Column) -> DataFrame:
    """E1. Distinct templates in order -> ``kind, variant_no, q``."""
    return df.select("*", F.posexplode(F.array_distinct(F.array_compact(templates))).alias("variant_no", "q")).select(
        *df.columns, F.lit(kind).alias("kind"), (F.col("variant_no") + 1).alias("variant_no"), "q")


def with_brand(companies: DataFrame) -> DataFrame:
    name = F.col("company_name")
    return companies.withColumn("brand", T.brand_text(name)).withColumn("searched", T.search_name(name))


def _variants(df: DataFrame, kind: str, templates: list[str], **cols: Column) -> DataFrame:
    return explode_variants(df, kind, F.array(*[fill(t, **cols) for t in templates]))


def site_queries(companies: DataFrame) -> DataFrame:
    """Q1."""
    return _variants(with_brand(companies), "site", [
        '"{b}" official website', '"{b}" company official site', "{n} official website", "{n} homepage"],
        b=F.col("brand"), n=F.col("company_name"))


def profile_queries(people: DataFrame) -> DataFrame:
    """Q2 on ``(person_name, company_name, designation)``."""
    df = with_brand(people)
    cols = {"p": F.col("person_name"), "c": F.trim("company_name"), "s": F.col("searched"), "b": F.col("brand"), "d": F.col("designation")}
    before = ["{p} {c}", "{p} {s}", "{b} {p} {net}", 'site:{site}/in "{p}" "{b}"', "site:{site}/in {p} {b}",
              'site:{site}/in "{p}" {b}', '"{p}" {b} {netlow}', '"{p}" "{b}" {netlow} profile']
    with_role = ['site:{site}/in "{p}" {d}', '"{p}" "{d}" {b} {netlow} profile']
    after = ['"{p}" {site}/in {b}', 'site:{site}/in "{p}"']
    stated = F.coalesce(F.col("designation"), F.lit("")) != ""
    return explode_variants(df, "profile", F.array(
        *[fill(t, **cols) for t in before], *[F.when(stated, fill(t, **cols)) for t in with_role], *[fill(t, **cols) for t in after]))


def registry_queries(companies: DataFrame) -> DataFrame:
    """Q3."""
    return _variants(with_brand(companies), "registry", [
        'site:zaubacorp.com "{s}"', 'site:zaubacorp.com "{b}"', 'zaubacorp "{n}" directors', "zaubacorp {b} company directors"],
        b=F.col("brand"), s=F.col("searched"), n=F.col("company_name"))


def officer_query(companies: DataFrame, matched: str = "alt_name") -> DataFrame:
    """Q3, focused follow-up."""
    name = F.coalesce(F.nullif(F.col(matched), F.lit("")), F.col("company_name"))
    return _variants(companies, "officer", ['site:zaubacorp.com "{m}" "Director"'], m=name)


def verify_queries(officers: DataFrame, matched: str = "matched_name") -> DataFrame:
    """Q4: full and short name forms through the same templates."""
    verified = F.coalesce(F.nullif(F.col(matched), F.lit("")), T.search_name(F.col("company_name")))
    df = (officers.withColumn("verified", verified).withColumn("brand", T.brand_text(F.col("verified")))
          .withColumn("full_name", P.clean_name(F.col("person_name"))).withColumn("brief", P.short_name(F.col("full_name"))))
    v, b, brief, c = F.col("verified"), F.col("brand"), F.col("brief"), F.col("company_name")
    role = F.coalesce(F.nullif(F.col("designation"), F.lit("")), F.lit("Director"))
    names = F.array_distinct(F.array("full_name", "brief"))

    def both(template: str) -> Column:
        return F.transform(names, lambda n: fill(template, n=n, v=v, b=b))

    return explode_variants(df, "verify", F.flatten(F.array(
        F.array(fill("{n} {c}", n=F.col("full_name"), c=F.trim(c))),
        both("{n} {v}"), both("{b} {n} {net}"), both('site:{site}/in "{n}" "{b}"'), both("site:{site}/in {n} {b}"),
        F.array(fill('"{s}" {b} {r} {net}', s=brief, b=b, r=role), fill('"{s}" "{c}" {net}', s=brief, c=c)),
        both('site:{site}/in "{n}"'))))


def title_queries(companies: DataFrame) -> DataFrame:
    """Q5, titles."""
    return _variants(companies, "titles", [
        'site:{site}/in "{n}" (director OR founder OR CEO OR chairman)',
        'site:{site}/in "{n}" "managing director"', 'site:{site}/in "{n}" founder'], n=F.col("company_name"))


def snippet_queries(companies: DataFrame) -> DataFrame:
    """Q5, snippets."""
    return _variants(with_brand(companies), "snippets", [
        '"{b}" "managing director" OR "chief executive officer"', '"{b}" board of directors names',
        '"{b}" leadership team chairman founder'], b=F.col("brand"))


def people_search_terms(people: DataFrame) -> DataFrame:
    """Q6."""
    df = with_brand(people).withColumn("company", F.coalesce(F.nullif(F.array_join(T.brand_tokens(F.col("company_name")), " "), F.lit("")), F.col("searched")))
    name = T.squash(F.col("person_name"))
    named = F.array(fill("{n} {c}", n=name, c=F.col("company")), fill("{n} {c}", n=P.short_name(F.col("person_name")), c=F.col("company")))
    roles = F.array(*[fill("{c} " + r, c=F.col("company")) for r in ("director", "founder", "CEO")])
    return explode_variants(df, "people", F.when(name != "", named).otherwise(roles)).where(F.col("company") != "")


def registry_slug(companies: DataFrame) -> DataFrame:
    """Q7."""
    slug = F.regexp_replace(F.regexp_replace(F.upper(T.brand_text(F.col("company_name"))), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    return companies.withColumn("slug", F.substring(slug, 1, 80))


def guessed_links(sites: DataFrame, links: DataFrame, thin: int = 2, n_paths: int = 8) -> DataFrame:
    """Q8 + J7. Conventional paths for pages ``(page_id, url)`` with fewer than
    ``thin`` ranked links, minus those already linked."""
    from rostrum.functions import urls as U
    found = links.groupBy("page_id").agg(F.count("*").alias("n"))
    guesses = (sites.join(found, "page_id", "left").where(F.coalesce("n", F.lit(0)) < thin)
               .select("page_id", F.explode(F.transform(T.one_of(vocab.GUESSED_PATHS[:n_paths]), lambda p: F.concat(
                   F.lit("https://"), U.host(F.col("url")), p))).alias("url")))
    known = links.select("page_id", F.regexp_replace("url", "/$", "").alias("url"))
    return guesses.join(known, ["page_id", "url"], "left_anti").select(
        "page_id", "url", F.concat(F.lit("guess:"), U.path(F.col("url"))).alias("text"), F.lit(99).alias("score"))


def host_variants(sites: DataFrame) -> DataFrame:
    """Q9 on ``(page_id, url)``."""
    from rostrum.functions import urls as U
    apex = U.domain(F.col("url"))
    forms = F.array_distinct(F.array(F.col("url"), *[F.concat(F.lit(a), apex, F.lit("/")) for a in ("https://www.", "https://", "http://www.")]))
    return sites.select("page_id", F.posexplode(forms).alias("variant_no", "variant_url"))
