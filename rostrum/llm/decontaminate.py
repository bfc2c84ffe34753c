"""Benchmark decontamination by suffix arrays of the training texts.

Each task cuts its documents into shards and builds a suffix array per shard:
the word positions whose next words can begin a test suffix, ordered by the
words that follow.  Every test suffix is binary-searched in every shard, which
gives all its verbatim occurrences; from each the match is extended to its full
length.  Documents are never shuffled.  The test set is the stated query set:
it is read in blocks of ``block_bytes``, each broadcast on its own and held
packed (13 hashes a word) by the workers.
"""
from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import grams

_FILTER_BITS = 20
FOUND = ("doc_id bigint, n_words bigint, n_hit bigint, items array<string>, longest_words bigint, longest_at bigint, "
         "longest_item string")


class TestBlock:
    """Windows of some test items, ready for the search."""

    def __init__(self, ids: list, texts: list, window: int, powers: grams.Powers) -> None:
        parts = list(grams.chunks(pa.array(texts, pa.string()), 1 << 62))
        _, _, data, offsets = parts[0] if parts else (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))
        words = grams.Words(grams.LOWER[data], offsets, grams.ALNUM, powers)
        n, room, text = len(words.hash), words.room(), words.text_of()
        # A short item is one window, so it counts from its first word only.
        length = np.minimum(room, window)
        at = np.flatnonzero((room >= window) | ((np.diff(text, prepend=-1) != 0) & (room < window)))
        at = at[(room[at] >= window) | (words.counts[text[at]] < window)]
        self.words, self.room = words.hash, room
        self.at, self.length = at, length[at]
        rows = np.zeros((len(at), window), np.uint64)
        for j in range(window):
            ok = self.length > j
            rows[ok, j] = words.hash[at[ok] + j]
        packed, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(at) else (rows, at, at)
        self.rows, self.row_length = packed, self.length[first]
        order = np.argsort(which.ravel(), kind="stable")
        names = np.array([None if ids[t] is None else str(ids[t]) for t in text[at]], object)[order] if len(at) else np.zeros(0, object)
        self.items = [sorted({x for x in part if x is not None}) for part in np.split(names, np.searchsorted(which.ravel()[order], np.arange(1, len(packed))))] if len(packed) else []
        # All test positions of each window, in the order of the words that follow.
        place = np.lexsort([_suffix_ranks(words.hash, room)[at], which.ravel()]) if len(at) else at
        self.places = at[place]
        self.row_first = np.searchsorted(which.ravel()[place], np.arange(len(packed) + 1))
        listed = sorted({str(x) for x in ids if x is not None})
        number = {x: i for i, x in enumerate(listed)}
        self.listed = listed
        self.place_item = np.array([len(listed) if ids[t] is None else number[str(ids[t])] for t in text[self.places]], np.int64)
        self.depth = min(3, int(self.row_length.min())) if len(packed) else 0
        self.heads = np.unique(grams.row_hash([packed[:, j] for j in range(self.depth)])) if self.depth else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << _FILTER_BITS, bool)
        self.sieve[self.heads >> np.uint64(64 - _FILTER_BITS)] = True


def _suffix_ranks(h: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Rank of each word position by the words from it to the end of its item
    (the end comes before any word), by doubling the length compared."""
    rank = np.unique(h, return_inverse=True)[1].ravel().astype(np.int64) + 1
    step, n = 1, len(h)
    while step < room.max(initial=0) and rank.max() < n:
        after = np.where(room > step, rank[np.minimum(np.arange(n) + step, n - 1)], 0)
        order = np.lexsort([after, rank])
        new = np.concatenate([[1], (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)]).astype(np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
    return rank


def _suffix_array(words: grams.Words, room: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Positions that share the first words of a test suffix, in the order of
    the words that follow, and those words (0 past the end of the text)."""
    width, n = block.rows.shape[1], len(words.hash) - block.depth + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros((0, width), np.uint64)
    head = grams.row_hash([words.hash[j:j + n] for j in range(block.depth)])
    at = np.flatnonzero(block.sieve[head >> np.uint64(64 - _FILTER_BITS)] & (room[:n] >= block.depth))
    at = at[np.isin(head[at], block.heads)]
    rows = np.zeros((len(at), width), np.uint64)
    for j in range(width):
        ok = room[at] > j
        rows[ok, j] = words.hash[at[ok] + j]
    order = np.lexsort(rows.T[::-1])
    return at[order], rows[order]


def _bound(rows: np.ndarray, wanted: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: the first row that is not
    less (``upper``: that is greater) than the first ``length`` words."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(rows), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        probe = rows[np.minimum(mid, len(rows) - 1)]
        used = np.arange(wanted.shape[1]) < length[:, None]
        differ = (probe != wanted) & used
        first = differ.argmax(1)
        pick = np.arange(len(wanted))
        less = differ[pick, first] & (probe[pick, first] < wanted[pick, first])
        right = open_ & (less | (~differ.any(1) if upper else False))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def _occurrences(words: grams.Words, room: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Word position and window of every occurrence in the shard."""
    at, rows = _suffix_array(words, room, block)
    if not len(at):
        return at, at
    lo = _bound(rows, block.rows, block.row_length, False)
    hi = _bound(rows, block.rows, block.row_length, True)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return at[lo[which] + inner], which


def _common(words: grams.Words, room: np.ndarray, block: TestBlock, pos: np.ndarray, place: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Equal words from each position and test place on, ``known`` of which are."""
    test = block.places[place]
    most = np.minimum(room[pos], block.room[test])
    length, live = np.array(known, np.int64), np.arange(len(pos))
    while len(live := live[length[live] < most[live]]):
        live = live[words.hash[pos[live] + length[live]] == block.words[test[live] + length[live]]]
        length[live] += 1
    return length


def _extend(words: grams.Words, room: np.ndarray, block: TestBlock, pos: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Length of the longest verbatim match from each occurrence on, with any
    test place of its window: the places are in order, so the best one is next
    to where the document's words would be put in."""
    lo, hi = block.row_first[which].copy(), block.row_first[which + 1].copy()
    base = block.row_length[which].astype(np.int64)
    low, high = base.copy(), base.copy()  # words shared with the place before lo and with the one at hi
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) >> 1
        n = _common(words, room, block, pos[live], mid, np.minimum(low[live], high[live]))
        test = block.places[mid]
        text_left, test_left = room[pos[live]] > n, block.room[test] > n
        a = words.hash[np.minimum(pos[live] + n, len(words.hash) - 1)]
        b = block.words[np.minimum(test + n, len(block.words) - 1)]
        right = text_left & (~test_left | (a > b))
        lo[live[right]], low[live[right]] = mid[right] + 1, n[right]
        hi[live[~right]], high[live[~right]] = mid[~right], n[~right]
    return np.maximum(low, high)


def _least_item(words: grams.Words, room: np.ndarray, block: TestBlock, pos: int, which: int, length: int) -> str | None:
    """Smallest item of the test places whose match has this length."""
    place = np.arange(block.row_first[which], block.row_first[which + 1])
    place = place[block.room[block.places[place]] >= length]
    for k in range(int(block.row_length[which]), length):
        place = place[block.words[block.places[place] + k] == words.hash[pos + k]]
    least = block.place_item[place].min()
    return block.listed[least] if least < len(block.listed) else None


def search(data: np.ndarray, offsets: np.ndarray, blocks: list, powers: grams.Powers) -> dict[str, list]:
    """Matches of one shard of texts with all test blocks."""
    words = grams.Words(grams.LOWER[data], offsets, grams.ALNUM, powers)
    n_texts, room, text = len(offsets) - 1, words.room(), words.text_of()
    hit = np.zeros(len(words.hash) + 1, np.int64)
    items: list[set] = [set() for _ in range(n_texts)]
    longest = [(0, None, None)] * n_texts
    for block in blocks:
        pos, which = _occurrences(words, room, block)
        if not len(pos):
            continue
        np.add.at(hit, pos, 1)
        np.add.at(hit, pos + block.row_length[which], -1)
        for t, w in np.unique(np.stack([text[pos], which]), axis=1).T:
            items[t].update(block.items[w])
        length = _extend(words, room, block, pos, which)
        order = np.lexsort([pos, -length, text[pos]])
        for i in order[np.flatnonzero(np.diff(text[pos][order], prepend=-1))]:
            t = text[pos[i]]
            n, at = int(length[i]), int(pos[i] - words.first[t])
            if (n, -at) >= (longest[t][0], -(longest[t][1] or 0)):
                item, held = _least_item(words, room, block, pos[i], which[i], n), longest[t]
                if (n, at) == held[:2] and held[2] is not None and (item is None or held[2] < item):
                    item = held[2]
                longest[t] = (n, at, item)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)]) if len(words.hash) else np.zeros(1, np.int64)
    return {"n_words": words.counts.tolist(), "n_hit": (covered[words.first[1:]] - covered[words.first[:-1]]).tolist(),
            "items": [sorted(x) for x in items], "longest_words": [x[0] for x in longest],
            "longest_at": [x[1] for x in longest], "longest_item": [x[2] for x in longest]}


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"] or "")
        size += len(texts[-1])
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, emit, schema) -> DataFrame:
    """``emit(rows, found)`` for each shard of ``docs``, without a shuffle."""
    sc, powers = docs.sparkSession.sparkContext, grams.Powers()
    made = (TestBlock(ids, texts, window, powers) for ids, texts in _blocks(benchmark, block_bytes))
    held = [sc.broadcast(vars(b)) for b in made if len(b.rows)]

    def run(batches):
        own, blocks = grams.Powers(), [SimpleNamespace(**b.value) for b in held]
        for batch in batches:
            for lo, hi, data, offsets in grams.chunks(batch.column("text")):
                yield emit(batch.slice(lo, hi - lo), search(data, offsets, blocks, own))

    return docs.mapInArrow(run, schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 1 << 23) -> DataFrame:
    """One row per row of ``docs``: words, words inside an occurrence of a test
    window, the test items that occur, and the longest verbatim match (its
    length in words, first word in the document, smallest item).

    Null or empty text has no words and no match; so has every document when
    the benchmark is empty.  A null ``item_id`` takes part in hits but is not
    listed.  Repeated rows are judged alike; other columns are not read.
    """
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "longest_words": pa.int64(),
             "longest_at": pa.int64(), "longest_item": pa.string()}

    def emit(rows, found):
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(found[k], t) for k, t in kinds.items()]],
                                          names=["doc_id", *kinds])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scan(docs, benchmark, window, block_bytes, emit, FOUND)


def is_contaminated(n_hit="n_hit", n_words="n_words", share: int = 20):
    """At least one in ``share`` words lies in an occurrence."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20,
                        block_bytes: int = 1 << 23) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept; null and empty
    texts stay.  The search runs beside the row, so nothing is joined."""
    def emit(rows, found):
        hit, words = np.array(found["n_hit"], np.int64), np.array(found["n_words"], np.int64)
        return rows.filter(pa.array(~((hit > 0) & (share * hit >= words))))

    return _scan(docs, benchmark, window, block_bytes, emit, docs.schema)
