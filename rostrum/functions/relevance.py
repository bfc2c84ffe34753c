"""Query constraints and relevance predicates."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import text as T
from rostrum.functions import urls as U


def query_constraints(q: Column) -> Column:
    """F1 -> STRUCT<site, phrases, tokens>."""
    site = F.regexp_extract(q, rf"(?i){T.WB}site:(\S+)", 1)
    phrases = F.transform(F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)), F.lower)
    bare = F.replace(F.regexp_replace(q, rf"(?i){T.WB}site:\S+", " "), F.lit('"'), F.lit(" "))
    toks = F.filter(F.split(F.regexp_replace(F.lower(bare), r"[^a-z0-9\s]", " "), r"\s+"),
                    lambda t: (F.length(t) >= 3) & ~T.in_words(t, vocab.QUERY_STOPWORDS))
    return F.struct(site.alias("site"), phrases.alias("phrases"), toks.alias("tokens"))


def _on_site(url: Column, site: Column) -> Column:
    wanted = F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace(site, "^(?i)https?://", ""), r"^(?i)www\.", ""))
    h, w = U.host(url), U.host(wanted)
    p = F.regexp_replace(U.path(wanted), "/$", "")
    here = U.path(url)
    return (U.is_web(url) & U.is_web(wanted) & ((h == w) | h.endswith(F.concat(F.lit("."), w)))
            & ((p == "") | (here == p) | here.startswith(F.concat(p, F.lit("/")))))


def is_relevant(url: Column, title: Column, snippet: Column, c: Column,
                trusted: bool = False, min_coverage: float = 0.0) -> Column:
    """F2 on one joined (query constraints, result) row."""
    low = F.lower(F.coalesce(url, F.lit("")))
    site_ok = (c["site"] == "") | _on_site(low, c["site"])
    if trusted:
        return F.coalesce(site_ok, F.lit(False))
    hay = F.lower(F.concat(low, F.lit(" "), F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))

    def covered(h: Column) -> Column:
        def seen(t: Column) -> Column:
            return h["hay"].contains(t) | h["tight"].contains(t)

        phrases_ok = F.forall(c["phrases"], lambda p: F.forall(
            F.filter(F.split(p, r"\s+"), lambda t: F.length(t) >= 3), seen))
        n = F.size(c["tokens"])
        tokens_ok = T.let(F.size(F.filter(c["tokens"], seen)), lambda hits: (hits > 0) & (hits / n >= min_coverage))
        return phrases_ok & ((F.size(c["phrases"]) > 0) | (n == 0) | tokens_ok)

    found = T.let(hay, lambda x: T.let({"hay": x, "tight": F.regexp_replace(x, "[^a-z0-9]", "")}, covered))
    return F.coalesce(site_ok & found, F.lit(False))


def low_trust_ok(engines: Column, url: Column, title: Column, snippet: Column, c: Column,
                 engine: str = "bing") -> Column:
    """F3. Rows seen only by the named engine need most query words."""
    only = (F.size(engines) > 0) & F.forall(
        engines, lambda e: F.coalesce(e, F.lit("")).rlike(rf"^(?i){engine}(?:_|(?![A-Za-z0-9_]))"))
    return ~only | is_relevant(url, title, snippet, c, min_coverage=vocab.MIN_TOKEN_COVERAGE)


def has_company_evidence(title: Column, snippet: Column, url: Column, company: Column,
                         non_names: list[str] | None = None) -> Column:
    """F4. Accent-folded; every distinctive word, or the joined brand."""
    def pick(brand: Column) -> Column:
        distinctive = T.company_words(F.array_join(brand, " "), non_names)
        return T.let(distinctive, lambda d: F.array_distinct(F.when(F.size(d) > 0, d).otherwise(brand)))

    slug = T.let(F.coalesce(url, F.lit("")), lambda u: F.when(U.is_web(u), U.profile_slug(u)).otherwise(""))
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), slug)
    words = F.filter(F.split(T.strip_accents(F.lower(text)), "[^a-z0-9]+"), lambda w: w != "")
    return T.let({"toks": T.let(T.brand_tokens(company), pick), "words": words}, lambda x: (
        (F.size(x["toks"]) > 0) & ((F.size(F.array_except(x["toks"], x["words"])) == 0)
                                   | F.array_join(x["words"], "").contains(F.array_join(x["toks"], "")))))


def company_evidence(title: Column, snippet: Column, url: Column, company: Column) -> Column:
    """F5 -> STRUCT<in_title, in_snippet>. Singularised, accents kept."""
    toks = F.filter(F.array_distinct(T.comparable_tokens(company)),
                    lambda t: (F.length(t) >= 3) & ~T.in_words(t, vocab.GENERIC_TOKENS))

    def matches(c: Column, wanted: Column) -> Column:
        words = F.transform(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""), T.singular)
        return T.let(words, lambda w: (F.size(F.array_except(wanted, w)) == 0)
                     | F.array_join(w, "").contains(F.array_join(wanted, "")))

    return T.let(toks, lambda w: F.struct(
        ((F.size(w) > 0) & (matches(title, w) | matches(url, w))).alias("in_title"),
        ((F.size(w) > 0) & matches(snippet, w)).alias("in_snippet")))


def looks_blocked(text: Column, links: Column) -> Column:
    """F7."""
    n = F.length(F.coalesce(text, F.lit("")))
    return ((n == 0) | ((n < 500) & text.rlike(f"(?i){vocab.BLOCK_PHRASES}"))
            | ((n < 200) & (links == 0)))


def is_challenge(text: Column, status: Column) -> Column:
    """F7, registry pages."""
    return text.rlike(f"(?i){vocab.CHALLENGE_PHRASES}") | ((status == 403) & (F.length(text) < 4000))
