"""Language identification by bit-sliced Bloom filters of n-grams.

All languages share one array of slots; a slot holds a bitmask with a bit for
each language.  The AND of an n-gram's slots names every language that contains
it.  A text's n-grams vote: the count of set bits by language, less the false
positives that the filling of its slice leads to expect, decides.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import grams, samples

LENGTHS = (2, 3, 4)
SLOT_BITS, PROBES = 20, 2
UNKNOWN = "und"
_SPACE = 0x20


def letters() -> np.ndarray:
    """Of each code point its lower case, or a space where it is no letter."""
    if "letters" not in (store := grams.worker_store()):
        table = np.full(0x110000, _SPACE, np.uint32)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        store["letters"] = table
    return store["letters"]


def text_grams(data: np.ndarray, offsets: np.ndarray, powers: grams.Powers):
    """Per length: hash of each n-gram and its text; and letters per text.  An
    n-gram has a letter, and nothing but letters between its ends."""
    cp = letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    # A space before and after each text.
    line = np.full(len(cp) + len(at), _SPACE, np.uint32)
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    line[np.arange(len(cp)) + text + 1] = cp
    owner = np.zeros(len(line), np.int32)
    owner[np.arange(len(cp)) + text + 1] = text
    letter = line != _SPACE
    up, down = powers.upto(len(line) + 1)
    total = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(grams.mix(line.astype(np.uint64) + np.uint64(977)) * up[:-1], out=total[1:])
    out = []
    for n in LENGTHS:
        m = len(line) - n + 1
        if m <= 0:
            continue
        ok = letter[:m] | letter[1:m + 1] if n == 2 else letter[1:m + 1].copy()
        for j in range(2, n - 1):
            ok &= letter[j:m + j]
        i = np.flatnonzero(ok)
        out.append((grams.mix((total[i + n] - total[i]) * down[i] + np.uint64(n)), np.where(letter[i], owner[i], owner[i + 1])))
    return out, np.bincount(text, cp != _SPACE, minlength=len(at) - 1)


class Filters(NamedTuple):
    """Languages in bit order, the slots' masks, and each slice's chance of a
    false positive."""
    langs: list[str]
    slots: np.ndarray
    chance: np.ndarray


def _slots_of(h: np.ndarray, bits: int):
    for i in range(PROBES):
        yield (grams.mix(h + np.uint64(i * 0x632BE59BD9B4E019)) if i else h) >> np.uint64(64 - bits)


def build(langs: list[str], members: list[np.ndarray], bits: int = SLOT_BITS) -> Filters:
    """One slice of the filter for each language's n-grams."""
    words = max(1, -(-len(langs) // 64))
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    slots = np.zeros((words, 1 << bits), kind)
    chance = np.zeros(len(langs))
    for i, h in enumerate(members):
        for s in _slots_of(h, bits):
            slots[i // 64, s] |= kind(1 << i % 64)
        chance[i] = (slots[i // 64] >> kind(i % 64) & kind(1)).mean() ** PROBES
    return Filters(langs, slots, chance)


def votes(filters: Filters, data: np.ndarray, offsets: np.ndarray, powers: grams.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Corrected share of each text's n-grams in each language; its letters."""
    n_texts, kind = len(offsets) - 1, filters.slots.dtype.type
    hits, n = np.zeros((n_texts, len(filters.langs))), np.zeros(n_texts)
    found, n_letters = text_grams(data, offsets, powers)
    bits = filters.slots.shape[1].bit_length() - 1
    for h, text in found:
        n += np.bincount(text, minlength=n_texts)
        probes = list(_slots_of(h, bits))
        for w in range(len(filters.slots)):
            mask = filters.slots[w][probes[0]]
            for s in probes[1:]:
                mask &= filters.slots[w][s]
            for i in range(w * 64, min(len(filters.langs), w * 64 + 64)):
                hits[:, i] += np.bincount(text[(mask >> kind(i % 64) & kind(1)).astype(bool)], minlength=n_texts)
    share = (hits / np.maximum(n, 1)[:, None] - filters.chance) / np.maximum(1 - filters.chance, 1e-9)
    return np.clip(share, 0, 1), n_letters


#: Parts in which the learning rows of a language are first ordered.
PARTS = 8


def fit(docs: DataFrame, learn: Column, max_rows: int = 1_000, least: int = 3, within: float = 40.0, bits: int = SLOT_BITS) -> Filters:
    """Filters from at most ``max_rows`` texts of each language for which
    ``learn`` holds.  A language contains an n-gram that occurs ``least`` times
    in its texts, not more than ``within`` times rarer than in any language.
    Rows without language or text teach nothing; of rows that repeat an id the
    least text does."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(learn)
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not langs:
        return build([], [])
    # First in a few parts of each language, so that no task orders a whole language.
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.pmod(F.hash("doc_id"), F.lit(PARTS)).alias("part")).withColumn("k", place).where(F.col("k") <= max_rows)
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = ids.withColumn("k", order).where(F.col("k") <= max_rows).select("doc_id", "lang").distinct()
    picked = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    picked = picked.select("lang", "text")

    def run(batches):
        powers = grams.Powers()
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in grams.chunks(batch.column("text")):
                own = sorted(set(names[lo:hi]))
                code = np.array([own.index(x) for x in names[lo:hi]])
                for h, text in text_grams(data, offsets, powers)[0]:
                    for i, lang in enumerate(own):
                        seen, n = np.unique(h[code[text] == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(n, pa.int64())],
                                                         names=["lang", "gram", "n"])

    counted = picked.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("n") >= least)
    got = counted.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).toArrow()
    hashes = got.column("gram").to_numpy().view(np.uint64)
    share = np.zeros((len(hashes), len(langs)))
    for row, by in enumerate(got.column("by").to_pylist()):
        for lang, n in by:
            share[row, langs.index(lang)] = n
    share /= np.maximum(share.sum(0), 1)
    top = share.max(1, initial=0)[:, None]
    inside = (share > 0) & (share * within >= top)
    return build(langs, [hashes[inside[:, i]] for i in range(len(langs))], bits)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each row's whole text.  A null
    text or one without a letter is ``und`` with score 0, as is every text when
    nothing was learned; of equal languages the first by name wins.  The score
    is the winner's part of all corrected shares."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(filters))

    def run(data, offsets, powers):
        f = Filters(*held.value)
        if not f.langs:
            return {"lang_pred": [UNKNOWN] * (len(offsets) - 1), "score": [0.0] * (len(offsets) - 1)}
        share, n_letters = votes(f, data, offsets, powers)
        best, total = share.argmax(1), share.sum(1)
        score = np.where(total > 0, share.max(1) / np.maximum(total, 1e-12), 0)
        none = n_letters == 0
        return {"lang_pred": [UNKNOWN if x else f.langs[b] for x, b in zip(none, best)], "score": np.where(none, 0.0, score)}

    return samples.map_texts(docs, run, {"lang_pred": pa.string(), "score": pa.float64()})
