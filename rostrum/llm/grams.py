"""Words and n-grams of a batch of texts as numpy arrays over their UTF-8 bytes.

Everything is worked out on whole Arrow buffers: no string is made per text,
word or n-gram.  A hash is a 64-bit polynomial over randomised byte values,
finished by a mixer; it is the same in every process.
"""
from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; some fifteen arrays of eight bytes a byte stand beside them.
CHUNK_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def worker_store() -> dict:
    """A place that lasts as long as the Python worker, across its tasks."""
    return sys.modules.setdefault("rostrum_worker_store", types.ModuleType("rostrum_worker_store")).__dict__


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash so that every bit depends on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    return mix((np.arange(1, 257, dtype=np.uint64)) * _U(_P))


class Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            room = max(n, CHUNK_BYTES + 1)
            self.up = self._of(_P, room)
            self.down = self._of(pow(_P, -1, 1 << 64), room)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _of(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)


def byte_table(pattern_bytes) -> np.ndarray:
    """Membership of each byte value."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: Bytes outside ASCII white space.
NOT_SPACE = byte_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, lower-case ASCII letters and every byte of a non-ASCII character.
ALNUM = byte_table(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: first
    row, row after the last, bytes, offset of each row (and the end).  A longer
    text is a run of its own; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends with its text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


class Words:
    """The words of a run of texts: hashes and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, powers: Powers) -> None:
        self.start, self.stop = spans(table[data], offsets)
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hash(data, self.start, self.stop, powers)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def span_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of each span of bytes, whatever its place."""
    up, down = powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[:-1], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)) | _U(1)


def row_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes, column by column."""
    out, step = columns[0] * _U(_P), 1
    for c in columns[1:]:
        step = step * 0xD6E8FEB86659FD93 % (1 << 64)
        out = out + c * _U(step | 1) * _U(_P)
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the word each begins at."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.room()[:n] >= k)
    return row_hash([words.hash[j:j + n] for j in range(k)])[at], at
