"""Search-result tables: merging, ranking, early stop, response shaping."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.functions import urls as U
from rostrum.functions.relevance import is_relevant, low_trust_ok, query_constraints


def _fold_snippets(rows: Column, grow) -> Column:
    ordered = F.array_sort(rows)
    return F.aggregate(F.filter(F.transform(ordered, lambda x: x["snippet"]), lambda s: s != ""), F.lit(""), grow)


def merge_fuller_title(hits: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """A2. One row per lower-cased address: title with most words, snippets that
    add something, in arrival order.

    Copies of a snippet collapse before the per-address step (they cannot change
    the result), so a much repeated hit never gathers in one task.
    """
    rows = T.once(hits.select(*keys, "pos", "href", "title", "snippet"), url=F.lower(U.unwrap_url(F.col("href")))).where(F.col("url").isNotNull()).select(
        *keys, "pos", "url", T.clean_title(F.col("title")).alias("title"), T.clean_title(F.col("snippet")).alias("snippet"))
    words = F.size(F.filter(F.split("title", " "), lambda t: t != ""))
    rank = F.struct(words.alias("w"), F.length("title").alias("n"), (-F.col("pos")).alias("p"), F.col("title"))

    def grow(acc: Column, s: Column) -> Column:
        return (F.when(acc.contains(s), acc)
                .when((acc != "") & ~s.contains(acc), F.concat(acc, F.lit(" "), s)).otherwise(s))

    return (rows.groupBy(*keys, "url", "snippet").agg(F.min("pos").alias("pos"), F.max(rank).alias("best"))
            .groupBy(*keys, "url").agg(
                F.max("best")["title"].alias("title"),
                _fold_snippets(F.collect_list(F.struct("pos", "snippet")), grow).alias("snippet"),
                F.min("pos").alias("first_pos")))


def merge_sources(hits: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """A3 over the union (E2) of several engines' hits
    ``(keys, pos, url, title, snippet, source)``; ``pos`` is arrival order."""
    rows = (T.once(hits, url=U.result_url(F.col("url"))).where(F.col("url").isNotNull())
            .select(*keys, "pos", "url", U.merge_key(F.col("url")).alias("merge_key"),
                    T.squash(F.col("title")).alias("title"), T.squash(F.col("snippet")).alias("snippet"), "source"))

    def grow(acc: Column, s: Column) -> Column:
        return F.when(acc.contains(s), acc).otherwise(F.trim(F.concat(acc, F.lit(" "), s)))

    first = F.min(F.struct("pos", "url"))
    title = F.max(F.struct(F.length("title").alias("n"), (-F.col("pos")).alias("p"), F.col("title")))
    ordered_sources = F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"])
    return (rows.groupBy(*keys, "merge_key", "snippet", "source")
            .agg(first.alias("first"), title.alias("best"), F.min("pos").alias("pos"))
            .groupBy(*keys, "merge_key").agg(
                F.min("first")["url"].alias("url"), F.max("best")["title"].alias("title"),
                _fold_snippets(F.collect_list(F.struct("pos", "snippet")), grow).alias("snippet"),
                F.array_distinct(ordered_sources).alias("sources"),
                F.min("pos").alias("first_pos")))


def relevant(queries: DataFrame, results: DataFrame, trusted: bool = False, min_coverage: float = 0.0,
             low_trust_engine: str | None = None) -> DataFrame:
    """F1 + F2 (+ F3) on the equi-join of queries ``(query_id, q)`` and results."""
    wants = T.once(queries.select("query_id", "q"), want=query_constraints(F.col("q"))).drop("q")
    rows = results.join(wants, "query_id")
    args = (F.col("url"), F.col("title"), F.col("snippet"), F.col("want"))
    keep = is_relevant(*args, trusted=trusted, min_coverage=min_coverage)
    if low_trust_engine:
        keep = keep & low_trust_ok(F.col("engines"), *args, engine=low_trust_engine)
    return rows.where(keep).drop("want")


def accepted_first(results: DataFrame, accepted: Column, limit: int | Column = 15,
                   keys: tuple[str, ...] = ("query_id",), order: str = "first_pos") -> DataFrame:
    """W7. Accepted rows first, arrival order within, top ``limit`` per query."""
    w = Window.partitionBy(*keys).orderBy(F.col("accepted").desc(), order)
    return (results.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
            .withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit))


def early_stop(rows: DataFrame, keys: tuple[str, ...], accepted: str | None = None, enough: int | None = None) -> DataFrame:
    """W9. Query variants are read in order until enough addresses are accepted
    (or, without a predicate, seen); rows of later variants are dropped.

    Only the per-variant counts go through a window, never the rows."""
    enough = enough or (2 if accepted else 5)
    hits = rows.where(F.col(accepted)) if accepted else rows
    fresh = (hits.groupBy(*keys, "url").agg(F.min("variant_no").alias("variant_no"))
             .groupBy(*keys, "variant_no").agg(F.count("*").alias("n")))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("variant_no"))
    stop = (fresh.withColumn("seen", running).where(F.col("seen") >= enough)
            .groupBy(*keys).agg(F.min("variant_no").alias("stop_variant")))
    return (rows.join(stop, list(keys), "left")
            .where(F.col("stop_variant").isNull() | (F.col("variant_no") <= F.col("stop_variant"))))


def best_evidence(rows: DataFrame, keys: tuple[str, ...], accepted: str) -> DataFrame:
    """A10. Per address: the first accepted row, else the longest (first on ties)."""
    size = F.length(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    ok = F.coalesce(F.col(accepted), F.lit(False))
    rank = F.struct(ok.alias("a"), F.when(ok, 0).otherwise(size).alias("n"),
                    (-F.col("variant_no")).alias("v"), (-F.col("pos")).alias("p"))
    best = F.max_by(F.struct("variant_no", "pos", "title", "snippet", ok.alias("accepted")), rank)
    return rows.groupBy(*keys, "url").agg(best.alias("best")).select(*keys, "url", "best.*")


def longest_snippet(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A12. Longest snippet per address, first on ties."""
    rank = F.struct(F.length(F.coalesce("snippet", F.lit(""))), -F.col("pos"))
    rest = [c for c in rows.columns if c not in (*keys, "url")]
    return (rows.groupBy(*keys, "url").agg(F.max_by(F.struct(*rest), rank).alias("best"))
            .select(*keys, "url", "best.*"))


def first_seen(rows: DataFrame, keys: tuple[str, ...], order: str = "pos") -> DataFrame:
    """W8. First row per key."""
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("one"))
            .select(*keys, "one.*"))


def run_sets(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A11. Providers used and distinct warnings of a run."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("provider")).alias("providers"),
                                   F.array_sort(F.collect_set("warning")).alias("warnings"))


def check_requests(requests: DataFrame) -> DataFrame:
    """F11. ``(q, num, engine, params ARRAY)`` -> the same plus ``error`` (NULL = valid)."""
    known = F.array(*[F.lit(p) for p in ("q", "num", "limit", "api_key", "engine")])
    num = F.when(F.col("num").isNull(), 10.0).otherwise(F.col("num").try_cast("double"))
    error = (F.when(F.col("q").isNull() | (F.trim("q") == "") | (F.length("q") > 1000), "q must contain 1 to 1000 characters")
             .when(num.isNull() | (num != F.floor(num)) | ~num.between(1, 50), "num must be an integer from 1 to 50")
             .when((F.size(F.array_except("params", known)) > 0)
                   | (F.col("engine").isNotNull() & ~F.col("engine").isin("google", "own")), "unsupported parameter"))
    return requests.withColumn("error", error)


def response_json(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """SNK4 on W7 output: the row list (at most 50 per query) under both names."""
    row = F.struct(F.col("position"), F.struct(F.col("title"), F.col("url").alias("link"), F.col("snippet"), F.col("position")).alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    return (ranked.groupBy(*keys).agg(rows.alias("organic"))
            .select(*keys, F.size("organic").alias("num"),
                    F.to_json(F.struct(F.struct(*keys, F.lit("own").alias("engine")).alias("searchParameters"),
                                       F.col("organic"), F.col("organic").alias("organic_results"))).alias("response")))
