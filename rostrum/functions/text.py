"""Company-name expressions.  Every function maps Columns to a Column."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import vocab

# White space as browsers see it, and ASCII-only word boundaries.
WS = r"[\s   -     　﻿]"
# No white space is a printed ASCII character: told at once, before the long class is tried.
NOT_PRINTED = "(?![!-~])"
WB = r"(?<![A-Za-z0-9_])"
WE = r"(?![A-Za-z0-9_])"


def words_re(words: list[str]) -> str:
    """Alternation of plain words; a space in a word matches any white space."""
    return "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in words)


def let(value, fn) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``fn``.
    ``value`` is a Column, or a dict of Columns passed on as one struct."""
    if isinstance(value, dict):
        value = F.struct(*[c.alias(k) for k, c in value.items()])
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``withColumns`` whose values are worked out exactly once per row.

    A filter on an ordinary derived column is pushed below it together with a
    second copy of its expression; a one-element ``explode`` keeps a costly
    expression in one place.
    """
    row = F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("_once")
    return df.select("*", row).select(*[c for c in df.columns if c not in cols], *[F.col("_once")[k].alias(k) for k in cols])


def one_of(words: list[str]) -> Column:
    """The words as one constant array."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({quoted})")


def in_words(t: Column, words: list[str]) -> Column:
    """Membership in a word list: a hash set for a long list, one constant array
    for a short one."""
    return t.isin(words) if len(words) > 100 else F.array_contains(one_of(words), t)


def squash(c: Column) -> Column:
    """Collapse white space and trim; NULL becomes an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), NOT_PRINTED + WS + "+", " "))


def tokens(c: Column, sep: str = WS + "+") -> Column:
    return F.filter(F.split(c, sep), lambda t: t != "")


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility decomposition by rule: letters whose decomposition is one
    base character go into ``translate``; longer ones become replacements."""
    src, dst, multi = [], [], []
    spans = [(0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2000, 0x2190), (0xFB00, 0xFB07),
             (0xFF01, 0xFF5F)]
    for lo, hi in spans:
        for cp in range(lo, hi):
            ch = chr(cp)
            flat = unicodedata.normalize("NFKD", ch)
            if flat == ch:
                continue
            flat = "".join(x for x in flat if not 0x300 <= ord(x) <= 0x36F)
            if len(flat) == 1:
                src.append(ch)
                dst.append(flat)
            elif flat.isascii() and flat.strip() and flat.isalpha():
                multi.append((ch, flat))
    marks = "".join(chr(cp) for cp in range(0x300, 0x370))
    return "".join(src) + marks, "".join(dst), multi


_FOLD_FROM, _FOLD_TO, _FOLD_MULTI = _fold_table()


def strip_accents(c: Column) -> Column:
    """S1. Plain-ASCII values skip the folding altogether."""
    multi = "[" + "".join(ch for ch, _ in _FOLD_MULTI) + "]"

    def spelled(x: Column) -> Column:
        for ch, flat in _FOLD_MULTI:
            x = F.replace(x, F.lit(ch), F.lit(flat))
        return x

    return let(c, lambda x: F.when(~x.rlike(r"[^\x00-\x7F]"), x)
               .when(x.rlike(multi), spelled(F.translate(x, _FOLD_FROM, _FOLD_TO)))
               .otherwise(F.translate(x, _FOLD_FROM, _FOLD_TO)))


def basic_clean(c: Column) -> Column:
    """S2."""
    return squash(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))),
                                   r"[^A-Za-z0-9_\s&]", " "))


def display_name(c: Column) -> Column:
    """S3."""
    return squash(c)


def search_name(c: Column, label: str = vocab.LIST_LABEL) -> Column:
    """S4."""
    return F.trim(F.regexp_replace(squash(c), rf"(?i)\s+(?:[-|]\s*)?{label}$", ""))


def _drop_suffixes(c: Column, suffixes: list[str]) -> Column:
    longest = sorted(suffixes, key=len, reverse=True)
    return F.regexp_replace(c, rf"(?:\s+(?:{words_re(longest)}))+$", "")


def company_key(c: Column) -> Column:
    """S5."""
    core = _drop_suffixes(basic_clean(search_name(c)),
                          vocab.LEGAL_SUFFIXES + vocab.DESCRIPTIVE_SUFFIXES)
    return F.array_join(
        F.filter(F.split(core, " "), lambda t: (t != "") & ~in_words(t, vocab.NAME_STOPWORDS)), " ")


def brand_tokens(c: Column) -> Column:
    """S6."""
    core = _drop_suffixes(basic_clean(search_name(c)),
                          vocab.LEGAL_SUFFIXES + vocab.BRAND_ONLY_SUFFIXES)
    return F.filter(F.split(core, " "),
                    lambda t: (t != "") & ~in_words(t, vocab.NAME_STOPWORDS + ["&"]))


def brand_text(c: Column) -> Column:
    """S15."""
    return F.coalesce(F.nullif(F.array_join(brand_tokens(c), " "), F.lit("")), c)


def same_company(a: Column, b: Column) -> Column:
    """S7 on two raw names."""
    def decide(k: Column) -> Column:
        hits = F.size(F.array_intersect(k["ta"], k["tb"]))
        return (F.when((k["a"] == "") | (k["b"] == ""), False)
                .when(k["a"] == k["b"], True)
                .otherwise((hits >= 1) & (hits / F.least(F.size(k["ta"]), F.size(k["tb"])) >= 0.8)))

    return let({"a": company_key(a), "b": company_key(b)}, lambda k: let(
        {"a": k["a"], "b": k["b"], "ta": F.array_distinct(F.split(k["a"], " ")),
         "tb": F.array_distinct(F.split(k["b"], " "))}, decide))


def company_words(c: Column, non_names: list[str] | None = None) -> Column:
    """S8. Accents are not folded here."""
    words = non_names or vocab.non_name_words()
    cleaned = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z\s]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda t: (F.length(t) >= 3) & ~in_words(t, words))


_ENTITIES = [("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]


def decode_entities(c: Column) -> Column:
    """S9. Decimal references are replaced one distinct code at a time; a text
    without an ampersand has none."""
    return let(F.coalesce(c, F.lit("")), lambda x: F.when(x.contains("&"), _decoded(x)).otherwise(x))


def _decoded(c: Column) -> Column:
    s = F.replace(c, F.lit("&amp;"), F.lit("&"))
    s = F.replace(s, F.lit("&quot;"), F.lit('"'))
    s = F.regexp_replace(s, "(?i)&#0?39;|&apos;|&#x27;", "'")
    for name, ch in _ENTITIES[1:]:
        s = F.replace(s, F.lit(name), F.lit(ch))

    def put(acc: Column, code: Column) -> Column:
        n = code.cast("int")
        plain = (n > 0) & (n < 0xD800) | (n > 0xDFFF) & (n < 0x10000)
        ch = F.when(plain, F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")).otherwise("")
        return F.replace(acc, F.concat(F.lit("&#"), code, F.lit(";")), ch)

    return let(s, lambda x: F.when(x.contains("&#"), F.aggregate(
        F.array_distinct(F.regexp_extract_all(x, F.lit(r"&#(\d{1,9});"), F.lit(1))), x, put)).otherwise(x))


def clean_title(c: Column) -> Column:
    """S10."""
    crumb = r"(?i)^.{0,90}?https?://\S+(?:\s*[›»>]\s*[^\s›»>]+)*\s*"
    return squash(F.regexp_replace(F.coalesce(c, F.lit("")), crumb, ""))


def singular(t: Column) -> Column:
    """S11."""
    return (F.when(F.length(t) <= 3, t)
            .when(t.rlike("[^aeiou]ies$"), F.concat(t.substr(F.lit(1), F.length(t) - 3), F.lit("y")))
            .when(t.rlike("(?:ses|xes|zes|ches|shes)$"), t.substr(F.lit(1), F.length(t) - 2))
            .when(t.rlike("[^s]s$"), t.substr(F.lit(1), F.length(t) - 1))
            .otherwise(t))


def comparable_tokens(c: Column) -> Column:
    """S12."""
    bare = F.transform(brand_tokens(c), lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))
    kept = F.filter(bare, lambda t: (t != "") & ~in_words(t, vocab.EXTRA_LEGAL_TOKENS))
    return F.transform(kept, singular)


def tokens_match(a: Column, b: Column) -> Column:
    """S13 + S14: equal, shared prefix of five or more, or a small edit distance."""
    la, lb = F.length(a), F.length(b)
    longest = F.greatest(la, lb)
    near = F.when(longest <= 5, F.levenshtein(a, b, 1)).otherwise(F.levenshtein(a, b, 2)) >= 0
    return ((a == b)
            | ((F.least(la, lb) >= 5) & (a.startswith(b) | b.startswith(a)))
            | near)


def escape_html(c: Column) -> Column:
    """S16."""
    s = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
