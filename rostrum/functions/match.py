"""Match scores over already joined pairs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions import people as P
from rostrum.functions import text as T
from rostrum.functions import urls as U


def site_score(url: Column, title: Column, snippet: Column, forms: Column) -> Column:
    """M1 on the brand's U7 forms -> STRUCT<domain, kind, score>; NULL when the
    row is no candidate."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))

    def total(x: Column) -> Column:
        base, hits, dom = x["base"], x["hits"], x["dom"]
        extra = (F.size(F.split(dom, r"\.")) > 2) & ~dom.rlike(r"^(?:www|in|us|uk|global|corp)\.")
        score = (base["score"] + F.when(x["text"].contains("official"), 3).otherwise(0)
                 + F.least(hits, F.lit(3)) * 2
                 - F.when(base["kind"].startswith("acronym") & (hits == 0), 8).otherwise(0)
                 + F.when(x["home"], 2).otherwise(0) - F.when(extra, 3).otherwise(0))
        return F.struct(dom.alias("domain"), base["kind"].alias("kind"), score.cast("int").alias("score"))

    def measure(x: Column) -> Column:
        return T.let({"dom": x["dom"], "text": x["text"], "home": x["home"],
                      "base": U.domain_score_of(U.domain_core(x["dom"]), x["forms"]),
                      "hits": F.size(F.filter(x["forms"]["words"], lambda t: (F.length(t) >= 3) & x["text"].contains(t)))}, total)

    home = F.regexp_replace(U.path(url), "/$", "") == ""
    ok = F.size(forms["words"]) > 0
    return F.when(ok, T.let(U.domain(url), lambda dom: F.when(~U.is_blocked_domain(dom), T.let({"dom": dom, "forms": forms, "text": text, "home": home}, measure))))


def name_similarity(a: Column, b: Column) -> Column:
    """M3 on two S12 token arrays -> STRUCT<score, distinctive>.

    Tokens of ``a`` take, in order, the first free matching token of ``b``.
    """
    return T.let({"a": F.array_distinct(a), "b": F.array_distinct(b)}, lambda x: _similarity(x["a"], x["b"]))


def _similarity(a: Column, b: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("used"),
                     F.lit(False).alias("distinctive"))

    def take(acc: Column, t: Column) -> Column:
        free = F.filter(F.transform(b, lambda x, i: F.when(
            T.tokens_match(t, x) & ~F.array_contains(acc["used"], i), i)), lambda i: i.isNotNull())
        telling = (F.length(t) >= 4) & ~T.in_words(t, vocab.GENERIC_TOKENS)
        return T.let(F.slice(free, 1, 1), lambda hit: F.struct(
            (acc["n"] + F.size(hit)).alias("n"),
            F.concat(acc["used"], hit).alias("used"),
            (acc["distinctive"] | ((F.size(hit) > 0) & telling)).alias("distinctive")))

    def finish(acc: Column) -> Column:
        return F.struct((acc["n"] / F.size(a) * 0.65 + acc["n"] / F.size(b) * 0.35).alias("score"),
                        acc["distinctive"].alias("distinctive"))

    none = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("distinctive"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), none).otherwise(F.aggregate(a, start, take, finish))


def name_verdict(sim: Column) -> Column:
    """M4 on an M3 result -> STRUCT<accepted, score, confidence, reason>."""
    return T.let(sim, _verdict)


def _verdict(sim: Column) -> Column:
    rounded = F.floor(sim["score"] * 100 + 0.5) / 100

    def out(ok: bool, conf: Column, reason: Column) -> Column:
        return F.struct(F.lit(ok).alias("accepted"), rounded.alias("score"), conf.alias("confidence"), reason.alias("reason"))

    low = F.lit("low")
    return (F.when(~sim["distinctive"], out(False, low, F.lit("no distinctive company word in common")))
            .when(sim["score"] < vocab.MATCH_ACCEPT, out(False, low, F.concat(
                F.lit("name similarity "), rounded.cast("string"), F.lit(f" below {vocab.MATCH_ACCEPT}"))))
            .otherwise(out(True, F.when(sim["score"] >= vocab.MATCH_HIGH, "high").otherwise("medium"), F.lit(""))))


def company_verdict(name_a: Column, name_b: Column) -> Column:
    """M3 + M4 on raw names."""
    return name_verdict(name_similarity(T.comparable_tokens(name_a), T.comparable_tokens(name_b)))


def profile_score(url: Column, title: Column, person: Column, company: Column, snippet: Column,
                  non_names: list[str] | None = None) -> Column:
    """M5."""
    company_toks = T.company_words(company, non_names)
    slug = F.when(U.is_profile_url(url), U.profile_slug(url))
    low = F.lower(F.coalesce(title, F.lit("")))

    def with_tokens(x: Column) -> Column:
        real = F.filter(x["full"], lambda t: F.length(t) >= 2)
        toks = F.when(F.size(real) < 2, x["full"]).otherwise(real)
        tight = F.regexp_replace(x["slug"], "[^a-z]", "")
        return T.let({
            "toks": toks, "words": real, "tight": tight, "slug": x["slug"], "low": x["low"],
            "parts": F.filter(F.split(x["slug"], r"[-_.\d]+"), lambda p: p != ""),
            "flat": T.squash(F.regexp_replace(x["low"], "[^a-z]+", " ")),
            "company": F.exists(x["company"], lambda t: x["employer"].contains(t) | tight.contains(t))}, points)

    scored = T.let({"full": P.all_name_tokens(person), "slug": slug, "low": low, "company": company_toks,
                    "employer": F.concat(low, F.lit(" "), F.lower(F.coalesce(snippet, F.lit(""))))}, with_tokens)
    return F.coalesce(scored, F.lit(0)).cast("int")


def points(x: Column) -> Column:
    """M5 arithmetic; NULL slug (not a profile address) gives NULL."""
    toks, words, tight, parts = x["toks"], x["words"], x["tight"], x["parts"]
    n = F.size(toks)
    first, last = F.get(toks, F.lit(0)), F.get(toks, n - 1)
    w_first, w_last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)

    def near_start(run: Column) -> Column:
        return F.instr(x["flat"], run).between(1, 25)

    named = (F.size(words) >= 2) & (near_start(F.array_join(words, " "))
                                    | near_start(F.concat_ws(" ", w_first, w_last))
                                    | near_start(F.concat_ws(" ", w_last, w_first)))
    surname = F.array_contains(parts, last) | tight.contains(last)
    in_slug = F.array_contains(parts, first)
    first_pts = (F.when(F.length(first) == 1, F.when(in_slug, 2).otherwise(0))
                 .when(in_slug | tight.contains(first), 6)
                 .when(tight.startswith(F.substring(first, 1, 3)), 2).otherwise(0))
    middle = F.slice(toks, F.lit(2), F.greatest(n - 2, F.lit(0)))
    middle_pts = F.size(F.filter(middle, lambda t: (F.length(t) >= 2) & tight.contains(t))) * 2
    in_title = F.size(F.filter(words, lambda t: x["low"].contains(t)))
    title_pts = F.when(x["low"] == "", 0).otherwise(
        F.when((F.size(words) > 0) & (in_title == F.size(words)), 5).otherwise(in_title * 2)
        + F.when(x["company"], 4).otherwise(0))
    score = 6 + first_pts + middle_pts + title_pts - F.when(x["slug"].rlike(r"\d{4,}"), 3).otherwise(0)
    capped = F.when((F.size(words) < 2) & ~x["company"], F.least(score, F.lit(vocab.PROFILE_ACCEPT - 1))).otherwise(score)
    return (F.when((n < 2) | x["slug"].isNull(), 0)
            .when(~surname, F.when(named & x["company"], vocab.PROFILE_ACCEPT + 2).otherwise(0))
            .otherwise(capped))
