"""Quality rules: a table of thresholds compiled into one projection.

All measures are built-in functions over the row's own arrays, so a text never
leaves its row and nothing is shuffled.  Repeated word windows are found by
sorting one array of longs per text (window hash above, position below), which
takes n log n steps whatever repeats.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


class Rule(NamedTuple):
    """A text passes when ``low <= measure <= high``; None leaves a side open."""
    name: str
    measure: str
    low: float | None
    high: float | None


#: The thresholds; measures are SQL over the columns of ``measured``.
RULES = [
    Rule("words", "n_words", 50, None),
    Rule("word_length", "word_chars / n_words", 2, 15),
    Rule("symbols", "n_symbols / n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    Rule("cut_lines", "n_cut_lines / n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words / n_words", None, 0.5),
]

#: Function words of the languages served; a caller with others passes its own.
STOP_WORDS = ("the of and to in that is with be it for on are as by this from at was or an "
              "der die das und den von mit ist im für nicht ein eine zu des sich auf "
              "le la les de des et en un une que du dans est pour qui par au sur "
              "el los las y del por para una como más su al con").split()


def _let(df: DataFrame, **cols: str) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in cols.items()})


def measured(docs: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """One row per row: ``doc_id`` and the measures (long).  Null text has no
    words and no lines.  Columns other than doc_id and text are not read."""
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(stop_words)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = _let(base, words=f"regexp_extract_all(text, r'{WORD}', 0)",
                 lines=rf"filter(split(text, r'\n', -1), l -> l rlike r'{WORD}')",
                 n_symbols=f"cast(char_length(text) - char_length(regexp_replace(text, r'{SYMBOL}', '')) as bigint)").drop("text")
    # Window hashes give their low bits to the position; equal hashes are then compared word by word.
    packed = _let(words, n_words="cast(size(words) as bigint)", low="shiftleft(1L, length(bin(size(words)))) - 1")
    packed = _let(packed, wins="""if(n_words < 3, array(), sort_array(transform(sequence(0, cast(n_words as int) - 3),
        i -> (xxhash64(words[i], words[i + 1], words[i + 2]) & ~low) | cast(i as bigint))))""")

    def same(other: str) -> str:
        at, there = "cast(x & low as int)", f"cast(get(wins, {other}) & low as int)"
        return (f"((get(wins, {other}) & ~low) = (x & ~low) and " +
                " and ".join(f"get(words, {at} + {j}) = get(words, {there} + {j})" for j in range(3)) + ")")

    found = _let(packed, at=f"sort_array(transform(filter(wins, (x, k) -> {same('k - 1')} or {same('k + 1')}), x -> x & low))")
    return found.select(
        "doc_id", "n_words", F.expr("cast(char_length(array_join(words, '')) as bigint)").alias("word_chars"), "n_symbols",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("aggregate(transform(at, (p, k) -> least(3L, get(at, k + 1) - p)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.expr(f"cast(size(filter(words, w -> lower(w) in ({stops}))) as bigint)").alias("n_stop_words"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr(r"cast(size(filter(lines, l -> l rlike r'^\s*[-*•]')) as bigint)").alias("n_bullet_lines"),
        F.expr(r"cast(size(filter(lines, l -> l rlike r'(\.\.\.|…)\s*$')) as bigint)").alias("n_cut_lines"))


def _passes(rule: Rule) -> Column:
    top, _, below = rule.measure.partition(" / ")
    value = F.expr(f"{top} / nullif({below}, 0)" if below else top)
    sides = [value >= rule.low] if rule.low is not None else []
    sides += [value <= rule.high] if rule.high is not None else []
    # A ratio over nothing has no value and breaks no rule.
    return F.coalesce(F.when(sides[0] & sides[-1], True).when(value.isNull(), True), F.lit(False)) if sides else F.lit(True)


def judged(measures: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``broken_rules`` (names, in the table's order) and ``passes``."""
    broken = F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]))
    return measures.withColumn("broken_rules", broken).withColumn("passes", F.size("broken_rules") == 0)
