"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells of (source, language, topic); the cells' token
weights are raked until their marginals meet the targets.  A cell's weight over
its tokens, scaled so that the wanted share of all tokens is expected, is the
probability with which each of its documents is kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.store import shared_table

DIMS = ("source", "lang", "topic")
#: Stands for a missing source or language.
NONE = "(none)"
#: A text has the topic of the first marker it contains; shorter ones without are ``short``, the rest ``prose``.
TOPIC_MARKS = [("contact", "@"), ("table", " | "), ("licence", "icense"), ("symbols", "### ")]
SHORT_CHARS = 400
#: Cells beyond this many are joined by a shuffle instead of a broadcast.
BROADCAST_CELLS = 200_000
SALTS = 16


def topic_of(text: Column) -> Column:
    out = F.when(text.contains(TOPIC_MARKS[0][1]), TOPIC_MARKS[0][0])
    for name, mark in TOPIC_MARKS[1:]:
        out = out.when(text.contains(mark), name)
    return out.when(F.length(text) < SHORT_CHARS, "short").otherwise("prose")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _cell(topic: Column | None) -> Column:
    """The cell of a row of documents."""
    own = topic if topic is not None else topic_of(F.coalesce("text", F.lit("")))
    return F.struct(F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
                    F.coalesce(own, F.lit(NONE)).alias("topic"))


def cells_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Rows and tokens of each cell, combined before the shuffle."""
    celled = docs.select(_cell(topic).alias("cell"), token_count(F.coalesce("text", F.lit(""))).alias("n"))
    return celled.groupBy("cell").agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens")).select("cell.*", "n_docs", "tokens")


def _target(cells: DataFrame, dim: str, wanted: dict[str, float], keep_unlisted: bool = False) -> Column:
    """Share of each value: the listed one, or its natural part of what the
    list leaves over; normalised over the values that have tokens.  A list
    that leaves nothing over gives the others 0; with ``keep_unlisted`` they
    keep their natural share of all tokens and the listed ones divide the rest,
    so that only a listed 0 drops documents."""
    named = sum(wanted.values())
    left = max(0.0, 1 - named)
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    listed = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(dim)] if wanted else F.lit(None).cast("double")
    have, rest, total = sums.agg(F.sum(listed), F.sum(F.when(listed.isNull(), F.col("t"))), F.sum("t")).first()
    have, rest = have or 0.0, rest or 0
    if keep_unlisted and rest and left < 1e-9:  # shares that add up to 1 but for rounding leave nothing
        left = have * rest / (total - rest) if have and total > rest else 1.0
    whole = have + (left if rest else 0.0)
    if not whole:
        return F.lit(0.0)
    natural = F.sum("tokens").over(Window.partitionBy(dim))
    return F.coalesce(listed, F.lit(left / rest if rest else 0.0) * natural) / F.lit(whole)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], tolerance: float = 1e-6, batch: int = 4, most: int = 50, keep_unlisted: bool = False) -> DataFrame:
    """``cells`` with ``weight``: tokens raked to the targets by dimension.

    Each step scales every value of one dimension to its target; one round does
    all dimensions.  Rounds run in batches, each written out, until the largest
    relative deviation is within ``tolerance`` (at most ``most`` batches: where
    empty cells make the targets contradict each other there is no fit, and the
    last round's weights stand, exact in the last dimension).  A value with the
    target 0 gets no weight.  Cells without tokens keep weight 0.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    shares = {d: _target(cells, d, targets.get(d, {}), keep_unlisted) for d in DIMS}
    state = shared_table(cells.select("*", F.col("tokens").cast("double").alias("weight"), *[(s * total).alias(f"to_{d}") for d, s in shares.items()]))
    for _ in range(most if total else 0):
        for _ in range(batch):
            for d in DIMS:
                now = F.sum("weight").over(Window.partitionBy(d))
                state = state.withColumn("_now", now).withColumns({
                    "weight": F.when(F.col("_now") > 0, F.col("weight") * F.col(f"to_{d}") / F.col("_now")).otherwise(0.0),
                    f"off_{d}": F.when(F.col("_now") > 0, F.abs(F.col(f"to_{d}") / F.col("_now") - 1)).otherwise(0.0)}).drop("_now")
        state = shared_table(state)
        if (state.agg(F.max(F.greatest(*[f"off_{d}" for d in DIMS]))).first()[0] or 0) <= tolerance:
            break
        state = state.drop(*[f"off_{d}" for d in DIMS])
    return state.select(*DIMS, "n_docs", "tokens", "weight")


def calibrate(raked: DataFrame, rate: float, points: int = 48, passes: int = 4) -> DataFrame:
    """``raked`` with ``probability`` = min(1, scale * weight / tokens), the
    scale such that ``rate`` of all tokens is expected.  A probability stays
    below 1 unless its cell is needed whole; if even whole cells are not enough,
    all cells with weight are whole.  The scale is bracketed by passes over the
    cells that try many values at once."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    cells = raked.withColumn("ratio", ratio)
    total, low, high = cells.where("ratio > 0 and tokens > 0").agg(F.sum("tokens"), F.min("ratio"), F.max("ratio")).first()
    everything = raked.agg(F.sum("tokens")).first()[0] or 0
    scale = 1.0
    if total:
        lo, hi = min(rate, 1.0) / high * 0.5, 1 / low
        if rate * everything >= total:
            scale = hi
        else:
            for _ in range(passes):
                grid = [lo * (hi / lo) ** (i / (points - 1)) for i in range(points)]
                got = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * F.col("ratio"))) for s in grid]).first()
                above = next((i for i, x in enumerate(got) if x >= rate * everything), points - 1)
                lo, hi = grid[max(0, above - 1)], grid[above]
            scale = hi
    return cells.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("ratio") * scale), 9)).drop("ratio")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]], rate: float, topic: Column | None = None, seed: int = 0, keep_unlisted: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``topic``, ``probability`` and
    ``sampled`` (replacing columns of these names).

    A missing source or language is a value of its own, ``(none)``; null text is
    empty.  Rows without tokens share their cell's probability (1 in a cell
    without any tokens).  The draw depends on the doc_id and the seed alone (on
    the text where doc_id is null), so repeated ids stay or go together and a
    second run draws alike.  An empty table stays empty.  Documents of a value
    that the targets don't list are dropped if the listed shares add up to 1,
    unless ``keep_unlisted`` leaves such values their natural share.
    """
    cells = shared_table(calibrate(rake(shared_table(cells_of(docs, topic)), targets, keep_unlisted=keep_unlisted), rate))
    drawn = (F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
             .bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    named = cells.select(F.struct(*DIMS).alias("cell"), "probability")
    # The row is one value, so that no column of it can have the name of one made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _cell(topic).alias("cell"), drawn.alias("draw"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("salt"))
    if cells.count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(named), "cell")
    else:  # a cell may hold a third of all rows: deal it out
        joined = rows.join(named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cell", "salt"])
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("topic", "probability", "sampled")]
    return joined.select(*rest, F.col("cell.topic").alias("topic"), "probability", (F.col("draw") < F.col("probability")).alias("sampled"))
