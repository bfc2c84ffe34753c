"""Resampling of documents towards a target distribution.

Runs of words are hashed into buckets by their checksum; a bucket's gain is the
log ratio of its share in the target texts and in all documents.  The gains are
one array, broadcast, and a document's weight is the mean gain of its features.
Weight plus seeded noise is the score, kept in a table.  The cutoff of the draw
is found by bisection: each job counts exactly how many rows reach some
thresholds between the known bounds, first of the score, then of the ids that
tie at it.  Only the drawn rows are ordered, by ranges, for their ranks.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import grams
from rostrum.llm.store import shared_table

#: Thresholds that one counting job tries.
PROBES = 15
#: Words up to this many bytes are hashed all at once, byte by byte.
SHORT = 48


def _checksum_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _checksum_table()


def checksum(state: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each span, carried on from ``state``."""
    size = stop - start
    order = np.argsort(-size, kind="stable")
    out, at, sorted_size = ~state[order], start[order], size[order]
    long_ = np.searchsorted(-sorted_size, -SHORT, "left")  # spans of more than SHORT bytes come first
    for i in range(long_):
        out[i] = ~np.uint32(zlib.crc32(data[at[i]:at[i] + sorted_size[i]].tobytes(), int(~out[i])))
    for j in range(int(sorted_size[long_]) if long_ < len(size) else 0):
        n = np.searchsorted(-sorted_size, -j, "left")  # spans of more than j bytes
        out[long_:n] = _TABLE[(out[long_:n] ^ data[at[long_:n] + j]) & np.uint32(255)] ^ (out[long_:n] >> np.uint32(8))
    back = np.empty(len(size), np.uint32)
    back[order] = ~out
    return back


_SPACE = np.frombuffer(b" ", np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each run of 1 to ``runs`` words of a text, words
    joined by one space, and the number of words of each text."""
    data = grams.LOWER[data]
    start, stop = grams.spans(grams.ALNUM[data], offsets)
    first = np.searchsorted(start, offsets)
    words = np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    begin = np.arange(len(start))  # first word of each run of k words
    texts, found = [text], [checksum(np.zeros(len(start), np.uint32), data, start, stop)]
    for k in range(1, runs):
        inside = begin + k < first[1:][text[begin]]  # one more word of the same text
        begin, blank = begin[inside], np.zeros(int(inside.sum()), np.int64)
        joined = checksum(found[-1][inside], _SPACE, blank, blank + 1)
        found.append(checksum(joined, data, start[begin + k], stop[begin + k]))
        texts.append(text[begin])
    return np.concatenate(texts), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), words


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows; a task sends at most one row a
    bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in grams.chunks(batch.column("text")):
                total += np.bincount(features(data, offsets, runs, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in grams.chunks(batch.column("text")):
                text, bucket, words = features(data, offsets, runs, len(held.value))
                n = np.bincount(text, minlength=hi - lo)
                order = np.argsort(text, kind="stable") if runs > 1 else slice(None)
                total = np.concatenate([[0], np.cumsum(held.value[bucket[order]])])
                ends = np.concatenate([[0], np.cumsum(n)])
                weight = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight.astype(np.int64))],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the id's hash; null counts as ''."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def _least(rows: DataFrame, key: Column, lo: int, hi: int, enough: int) -> int:
    """Smallest threshold in lo..hi that at least ``enough`` rows do not exceed;
    ``hi`` is one.  Each job counts the rows of PROBES thresholds exactly."""
    lo -= 1  # too few
    while hi - lo > 1:
        tried = sorted({lo + (hi - lo) * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {lo})
        for t, n in zip(tried, rows.agg(*[F.count(F.when(key <= t, 1)).alias(f"n{i}") for i, t in enumerate(tried)]).first()):
            if n >= enough:
                hi = t
                break
            lo = t
    return hi


def draw(scored: DataFrame, wanted: int) -> Column:
    """Condition on the rows of ``scored`` (a stored table with score and
    doc_id) that holds for the ``wanted`` highest scores, ties to the smaller
    doc_id (null last).  Rows that repeat the id at the very cutoff all satisfy
    it; their ranks tell them apart."""
    if wanted < 1:
        return F.lit(False)
    low, high = scored.agg(F.min(-F.col("score")), F.max(-F.col("score"))).first()
    cut = -_least(scored, -F.col("score"), low, high, wanted)
    still = wanted - scored.where(F.col("score") > cut).count()
    ties = scored.where((F.col("score") == cut) & F.col("doc_id").isNotNull())
    n, first, last = ties.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    tied = F.lit(True) if still > n else F.coalesce(F.col("doc_id") <= _least(ties, F.col("doc_id"), first, last, still), F.lit(False))
    return (F.col("score") > cut) | ((F.col("score") == cut) & tied)


def ranked(drawn: DataFrame, wanted: int) -> DataFrame:
    """``drawn`` with ``rank`` 1, 2, ... by falling score, then doc_id (null
    last); null beyond ``wanted``.  Rows are dealt out by ranges of that order,
    so a partition needs only the number of rows before it."""
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "_copy"]
    rows = drawn.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_copy")
    rows = shared_table(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part")).count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = F.broadcast(sizes.select("part", F.coalesce(before, F.lit(0)).alias("_base")))  # one row a partition
    rank = F.col("_base") + place + 1
    return rows.join(bases, part == F.col("part")).withColumn("rank", F.when(rank <= wanted, rank)).drop("_at", "_base", "part")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = 10_000,
             seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of
    ``docs``; ``percent`` of those with ``least_words`` words are drawn.

    Words are runs of letters and digits (every character beyond ASCII counts as
    one), lower-cased from A to Z.  Null and empty texts have no features,
    weight 0 and are not drawn.  A null doc_id is hashed as empty and comes
    last among ties.  Rows that repeat a doc_id are rows of their own; where
    they tie in all columns, any of them has the smaller rank.  Without target
    texts the gains only reflect the documents; an empty ``docs`` gives no row.
    Other columns are not read.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = shared_table(weigh(docs, gain, runs).withColumn("score", F.col("weight") + noise(seed)))
    able = scored.where(F.col("n_words") >= least_words)
    wanted = able.count() * percent // 100
    inside = (F.col("n_words") >= least_words) & draw(able, wanted)
    rest = scored.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(inside), wanted).unionByName(rest) if wanted else rest
