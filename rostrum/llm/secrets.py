"""Secret scans with multipart credential linking, in built-in functions only.

Strong patterns report by themselves.  Weak parts (an account name, a bare
token, an address) are reported only where complementary parts stand within
``reach`` characters in one scope, a stretch of text without a blank line: an
identifier needs a secret, a secret needs an identifier or an endpoint, an
endpoint needs both.  Parts become rows, and an interval join on document, scope
and stretch of text finds the partners.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.store import shared_table


class Pattern(NamedTuple):
    """``role`` is identifier, secret or endpoint; ``passes`` is SQL over the
    match ``m`` and the group ``g``."""
    kind: str
    role: str
    regex: str
    group: int = 0
    passes: str = "true"


#: Always reported, in this order at one start.
STRONG = [
    Pattern("assign", "secret", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(g) >= 8"),
    Pattern("access", "identifier", r"AKIA[A-Z0-9]+", 0, "length(m) >= 16"),
    Pattern("hex", "secret", r"[0-9a-f]{32,}"),
]
#: Reported only with complementary parts.
WEAK = [
    Pattern("ident", "identifier", r"""(?i:(?:access_?key_?id|client_?id|username|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,})"""),
    Pattern("phrase", "secret", r"""(?i:(?:pwd|pass|pin|auth|credentials?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#%-]{4,})"""),
    Pattern("mixed", "secret", r"[A-Za-z0-9+/_-]{20,}", 0, "m rlike '[0-9]' and m rlike '[a-z]' and m rlike '[A-Z]'"),
    Pattern("endpoint", "endpoint", r"""https?://[A-Za-z0-9.:/_-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}"""),
]
BLANK = r"\n[\x20\t]*\n"
REACH = 400
_SPAN = "array<struct<start: bigint, no: int, stop: bigint, kind: string, role: string>>"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sums_before(array: str) -> str:
    """SQL: for each element the sum of those before it, by blocks of about the
    square root of the length, so that long arrays stay far from quadratic."""
    add = "0L, (a, x) -> a + x"
    each = ("flatten(transform(sequence(0, size(blk) - 1), k -> transform(sequence(0, least(w, size(u) - k * w) - 1), "
            f"j -> beg[k] + aggregate(slice(u, k * w + 1, j), {add}))))")
    begins = _let("beg", f"transform(sequence(0, size(blk) - 1), k -> aggregate(slice(blk, 1, k), {add}))", each)
    blocks = _let("blk", f"transform(sequence(0, (size(u) - 1) div w), k -> aggregate(slice(u, cast(k * w + 1 as int), w), {add}))", begins)
    return _let("u", array, "if(size(u) = 0, cast(array() as array<bigint>), " + _let("w", "cast(ceil(sqrt(size(u))) as int)", blocks.replace("k * w + 1", "cast(k * w + 1 as int)")) + ")")


def _quoted(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(p: Pattern, no: int) -> str:
    """SQL: spans of a pattern in ``text``, leftmost and non-overlapping; ends
    are exclusive and count code points."""
    rx = _quoted(p.regex)
    gaps = f"transform(slice(split(text, {rx}, -1), 1, size(ms)), x -> cast(length(x) as bigint))"
    groups = f"regexp_extract_all(text, {rx}, {p.group})" if p.group else "ms"
    at = sums_before("zip_with(gaps, ms, (x, m) -> x + length(m))")
    spans = (f"filter(transform(sequence(0, size(ms) - 1), i -> {_let('s', 'pre[i] + gaps[i]', _let('m', 'ms[i]', _let('g', 'gs[i]', _struct(p, no))))}), y -> y is not null)")
    inner = _let("gaps", gaps, _let("gs", groups, _let("pre", at, spans)))
    return _let("ms", f"regexp_extract_all(text, {rx}, 0)", f"if(size(ms) = 0, cast(array() as {_SPAN}), {inner})")


def _struct(p: Pattern, no: int) -> str:
    made = f"named_struct('start', s, 'no', {no}, 'stop', s + length(m), 'kind', '{p.kind}', 'role', '{p.role}')"
    return made if p.passes == "true" else f"if({p.passes}, {made}, null)"


def _scanned(docs: DataFrame) -> DataFrame:
    """Per row its strong spans and, where a weak one may matter, all parts
    with the number of the scope they begin in."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("mark", F.xxhash64("doc_id", "text"))
    found = text.withColumns({f"k{i}": F.expr(_located(p, i)) for i, p in enumerate([*STRONG, *WEAK])} | {
        "breaks": F.expr(_located(Pattern("", "break", BLANK), -1))}).drop("text")
    strong = "concat(" + ", ".join(f"k{i}" for i in range(len(STRONG))) + ")"
    weak = "concat(" + ", ".join(f"k{i + len(STRONG)}" for i in range(len(WEAK))) + ")"
    both = found.select("doc_id", "mark", F.expr(f"array_sort({strong})").alias("strong"), F.expr(weak).alias("weak"), "breaks")
    # Without a secret and a partner for it no weak part can be reported.
    roles = "transform(concat(strong, weak), x -> x.role)"
    both = both.withColumn("all", F.expr(f"""if(size(weak) > 0 and array_contains({roles}, 'secret') and arrays_overlap({roles}, array('identifier', 'endpoint')),
        array_sort(concat(strong, weak, breaks)), cast(array() as {_SPAN}))"""))
    scope = sums_before("transform(all, x -> if(x.no < 0, 1L, 0L))")
    return both.select("doc_id", "mark", "strong", F.expr(
        f"filter(zip_with(all, {scope}, (x, s) -> named_struct('part', x, 'scope', s)), y -> y.part.no >= 0)").alias("parts"))


def _near(seek: DataFrame, offer: DataFrame, reach: int) -> DataFrame:
    """Rows of ``seek`` with a row of ``offer`` at most ``reach`` away in the
    same scope, not overlapping: an equi-join on the stretches that either
    touches, then the exact distance.  A semi-join keeps pairs from piling up."""
    def cut(df, lo, hi):
        return df.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("start") - lo) / reach), F.floor((F.col("stop") + hi) / reach))))

    a = cut(seek, 0, 0).alias("a")
    b = cut(offer, reach, reach).select("doc_id", "mark", "scope", "stretch", F.col("start").alias("b_start"), F.col("stop").alias("b_stop")).alias("b")
    on = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("mark", "scope", "stretch")]
    gap = F.greatest(F.col("b_start") - F.col("stop"), F.col("start") - F.col("b_stop"))
    return a.join(b, [*on, gap.between(0, reach)], "left_semi").drop("stretch").distinct()


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per row: ``doc_id``, ``strong`` and ``spans``, arrays of
    (start, no, stop, kind, role) by start, then kind; ``spans`` holds the
    strong ones and the weak ones whose complement is near.

    Null text counts as empty and has none.  A weak part that overlaps a strong
    span is part of it and not reported.  Repeated rows are judged alike.
    Columns other than doc_id and text are not read.
    """
    scanned = shared_table(_scanned(docs))
    rows = scanned.where(F.size("parts") > 0).select("doc_id", "mark", F.explode("parts").alias("p"))
    parts = shared_table(rows.select("doc_id", "mark", "p.scope", "p.part.*").distinct())
    strong, weak = parts.where(F.col("no") < len(STRONG)), parts.where(F.col("no") >= len(STRONG))

    secret, name, place = (parts.where(F.col("role") == r) for r in ("secret", "identifier", "endpoint"))
    linked = (_near(weak.where("role = 'identifier'"), secret, reach)
              .union(_near(weak.where("role = 'secret'"), name.union(place), reach))
              .union(_near(_near(weak.where("role = 'endpoint'"), secret, reach), name, reach)))
    inside = strong.select("doc_id", "mark", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("stop") / reach))).alias("stretch"),
                           F.col("start").alias("b_start"), F.col("stop").alias("b_stop")).alias("b")
    cut = linked.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("stop") / reach)))).alias("a")
    hidden = cut.join(inside, [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.mark") == F.col("b.mark"), F.col("a.stretch") == F.col("b.stretch"),
                               F.col("a.start") < F.col("b_stop"), F.col("b_start") < F.col("a.stop")], "left_semi").drop("stretch")
    shown = linked.withColumn("hit", F.lit(1)).union(hidden.withColumn("hit", F.lit(-1)))
    shown = shown.groupBy("doc_id", "mark", "start", "no", "stop", "kind", "role").agg(F.min("hit").alias("hit")).where("hit > 0")
    extra = shown.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "no", "stop", "kind", "role")).alias("extra")).withColumnsRenamed({"doc_id": "x_id", "mark": "x_mark"})
    joined = scanned.join(extra, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("mark") == F.col("x_mark")), "left")
    spans = F.when(F.col("extra").isNull(), F.col("strong")).otherwise(F.array_sort(F.concat("strong", "extra")))
    return joined.select("doc_id", "strong", spans.alias("spans"))


def listed(spans: str) -> str:
    """SQL: an array of spans as kind:start:stop, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"
