"""Token counts by a map-side two-tier lookup.

A text is normalised and cut into pre-tokens as numpy arrays.  The length in
tokens of frequent pre-tokens comes from a broadcast, direct-mapped hash table;
what it lacks goes through a cache that each Python worker keeps, and only a
pre-token new to the worker is encoded by the library.  Pre-tokens are never
shuffled: for the table, tasks send summaries of bounded size.

The numpy path covers characters below U+0300, whose normal form and class are
asked from the library one by one.  A text with any other character, or with a
special string of the vocabulary, is normalised and cut by the library itself,
and looked up in the same cache.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import grams

_TOP = 0x300
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: Suffixes after an apostrophe that the vocabulary's pattern takes as one piece (fixed values).
SUFFIX_ONE, SUFFIX_TWO = "stmd", ("re", "ve", "ll")
CACHE_ENTRIES = 300_000


class Pieces:
    """The tokenizer, what it says of each low character, and the cache."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(source)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.low = np.zeros(_TOP, np.uint32)
        self.kind = np.full(_TOP, ODD, np.uint8)
        cut = self.tok.pre_tokenizer.pre_tokenize_str
        for cp in range(_TOP):
            ch = self.tok.normalizer.normalize_str(chr(cp))
            if len(ch) != 1 or ord(ch) >= _TOP:
                continue
            self.low[cp] = ord(ch)
            self.kind[cp] = (SPACE if not cut(ch) else LETTER if len(cut("a" + ch)) == 1 else NUMBER if len(cut(ch + ch)) == 2 else OTHER)
        self.value = grams.mix(np.arange(1, _TOP + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.powers, self.known, self.slow = grams.Powers(), {}, {}

    @classmethod
    def get(cls, source: str) -> Pieces:
        store = grams.worker_store()
        if store.get("source") != source:
            store.update(source=source, pieces=cls(source))
        return store["pieces"]

    def split(self, data: np.ndarray, offsets: np.ndarray):
        """Hashes, spans and texts of the pieces, the normalised characters,
        and which texts need the library."""
        raw = data.tobytes()
        lead = (data & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[offsets]
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        low_cp = np.minimum(cp, _TOP - 1)
        kind = np.where(cp < _TOP, self.kind[low_cp], ODD).astype(np.uint8)
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(at, np.flatnonzero(kind == ODD), "right") - 1] = True
        for m in re.finditer("|".join(map(re.escape, self.special)).encode() or rb"(?!)", raw):
            odd[np.searchsorted(offsets, m.start(), "right") - 1] = True
        chars = self.low[low_cp]
        n = len(cp)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        edge[0:n] |= kind == NUMBER
        edge[1:n] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(edge[:n] & (kind != SPACE)) if n else np.zeros(0, np.int64)
        cuts = np.append(np.flatnonzero(edge[:n]), n)
        stop = cuts[np.searchsorted(cuts, start, "right")] if len(start) else start
        text = np.searchsorted(at, start, "right") - 1
        start, stop, text = self._suffixes(chars, kind, start, stop, text)
        keep = ~odd[text] if len(text) else np.zeros(0, bool)
        start, stop, text = start[keep], stop[keep], text[keep]
        up, down = self.powers.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[chars] * up[:n], out=total[1:])
        h = grams.mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
        return h, start, stop, text, chars, odd

    @staticmethod
    def _suffixes(chars, kind, start, stop, text):
        """An apostrophe alone before a known suffix takes it along."""
        if len(start) < 2:
            return start, stop, text
        i = np.flatnonzero((chars[start[:-1]] == ord("'")) & (stop[:-1] - start[:-1] == 1) & (start[1:] == stop[:-1])
                           & (text[1:] == text[:-1]) & (kind[start[1:]] == LETTER))
        one = np.isin(chars[start[i + 1]], [ord(c) for c in SUFFIX_ONE])
        room = stop[i + 1] - start[i + 1] >= 2
        second = chars[np.minimum(start[i + 1] + 1, len(chars) - 1)]
        two = np.zeros(len(i), bool)
        for a, b in SUFFIX_TWO:
            two |= room & (chars[start[i + 1]] == ord(a)) & (second == ord(b))
        take = np.where(one, 1, np.where(two, 2, 0))
        start, stop = start.copy(), stop.copy()
        stop[i] += take
        start[i + 1] += take
        keep = start < stop
        return start[keep], stop[keep], text[keep]

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch(pieces, add_special_tokens=False)]

    def lengths(self, h, start, stop, chars, table) -> np.ndarray:
        """Tokens of each piece: table, then cache, then library."""
        keys, sizes = table
        slot = (h >> np.uint64(64 - int(len(keys)).bit_length() + 1)).astype(np.int64)
        out = np.where(keys[slot] == h, sizes[slot], 0).astype(np.int64)
        miss = np.flatnonzero(keys[slot] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            known = [self.known.get(x, 0) for x in new.tolist()]
            lack = [i for i, x in enumerate(known) if not x]
            if lack:
                at = miss[first[lack]]
                got = self.encode([chars[a:b].tobytes().decode("utf-32-le") for a, b in zip(start[at], stop[at])])
                for i, x in zip(lack, got):
                    known[i] = x
                if len(self.known) + len(lack) > CACHE_ENTRIES:
                    self.known.clear()
                self.known.update(zip(new[lack].tolist(), got))
            out[miss] = np.array(known)[back.ravel()]
        return out

    def slowly(self, text: str) -> int:
        """One text cut by the library: special strings count one each."""
        total = 0
        for part in self.special_re.split(text):
            for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                if piece not in self.slow:
                    if len(self.slow) >= CACHE_ENTRIES:
                        self.slow.clear()
                    self.slow[piece] = len(self.tok.model.tokenize(piece))
                total += self.slow[piece]
        return total + len(self.special_re.findall(text))


def _frequent(docs: DataFrame, source, entries: int, per_task: int) -> DataFrame:
    """The most frequent pre-tokens of all texts, from summaries by task."""
    def run(batches):
        pieces, counts, names = Pieces.get(source.value), Counter(), {}

        def trim(most):
            for h, _ in counts.most_common()[most:]:
                del counts[h], names[h]

        for batch in batches:
            for _, _, data, offsets in grams.chunks(batch.column("text")):
                h, start, stop, _, chars, _ = pieces.split(data, offsets)
                seen, first, n = np.unique(h, return_index=True, return_counts=True)
                often = n > 1
                counts.update(dict(zip(seen[often].tolist(), n[often].tolist())))
                for x, i in zip(seen[often].tolist(), first[often]):
                    if x not in names:
                        names[x] = chars[start[i]:stop[i]].tobytes().decode("utf-32-le")
                if len(counts) > 8 * per_task:
                    trim(4 * per_task)
        trim(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([names[h] for h in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         names=["piece", "n"])

    return (docs.select("text").mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "piece").limit(entries))


def _table(pieces: Pieces, frequent: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Direct-mapped table; of two pieces with one slot the more frequent stays."""
    keys, sizes = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint16)
    for piece, size in zip(frequent[::-1], pieces.encode(frequent[::-1])):
        data = np.frombuffer(piece.encode(), np.uint8)
        h = pieces.split(data, np.array([0, len(data)]))[0]
        if len(h) == 1 and size < 1 << 16:
            slot = int(h[0]) >> (64 - bits)
            keys[slot], sizes[slot] = h[0], size
    return keys, sizes


def count_tokens(docs: DataFrame, tokenizer_path: str, entries: int = 16_384, per_task: int = 4_096) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text
    by the vocabulary file at ``tokenizer_path`` (lower case, white space
    dropped, pieces as in its pattern), without added special tokens.

    Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows count each.
    ``entries`` bounds the broadcast table, ``per_task`` a task's summary; both
    change the speed only.  Other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        source = sc.broadcast(f.read())
    found = [r["piece"] for r in _frequent(docs, source, entries, per_task).collect()]
    table = sc.broadcast(_table(Pieces(source.value), found, max(1, entries.bit_length() + 1)))

    def run(batches):
        pieces = Pieces.get(source.value)
        for batch in batches:
            for lo, hi, data, offsets in grams.chunks(batch.column("text")):
                h, start, stop, text, chars, odd = pieces.split(data, offsets)
                total = np.bincount(text, pieces.lengths(h, start, stop, chars, table.value), minlength=hi - lo).astype(np.int64)
                for i in np.flatnonzero(odd):
                    total[i] = pieces.slowly(data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64()),
                                                  pa.array(total, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
