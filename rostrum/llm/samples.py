"""Maps over whole texts, and bounded samples of them for training."""
from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rostrum.llm import grams


def fold(key: str, folds: int) -> Column:
    """Remainder of the checksum of an id as text."""
    return F.crc32(F.col(key).cast("string")) % folds


def take(docs: DataFrame, ids: DataFrame, most: int, pack: Callable) -> list[Row]:
    """At most ``most`` rows (doc_id, label and the binary columns of ``pack``)
    of documents named in ``ids``, the same ones at every run: ids in the order
    of their hash.  Only ids are sorted; the chosen few are broadcast to the
    scan, so no text is shuffled.  A repeated id counts once."""
    chosen = (ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    names = list(pack(*next((d, o) for _, _, d, o in grams.chunks(pa.array([""]))), grams.Powers()))

    def run(batches):
        powers = grams.Powers()
        for batch in batches:
            for lo, hi, data, offsets in grams.chunks(batch.column("text")):
                got = pack(data, offsets, powers)
                keep = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "label")]
                yield pa.RecordBatch.from_arrays([*keep, *[pa.array(got[n], pa.binary()) for n in names]], names=["doc_id", "label", *names])

    packed = picked.mapInArrow(run, "doc_id bigint, label int" + "".join(f", {n} binary" for n in names))
    return sorted(packed.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])


def map_texts(docs: DataFrame, fn: Callable, kinds: dict[str, pa.DataType]) -> DataFrame:
    """``doc_id`` and the columns that ``fn(bytes, offsets, powers)`` makes of
    every whole text, by one map."""
    def run(batches):
        powers = grams.Powers()
        for batch in batches:
            for lo, hi, data, offsets in grams.chunks(batch.column("text")):
                got = fn(data, offsets, powers)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(got[k], t) for k, t in kinds.items()]],
                                                 names=["doc_id", *kinds])

    schema = ", ".join(["doc_id bigint"] + [f"{k} {'double' if t == pa.float64() else 'string' if t == pa.string() else 'bigint'}" for k, t in kinds.items()])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_texts(docs: DataFrame, fn: Callable) -> DataFrame:
    """The rows of ``docs`` whose text ``fn(bytes, offsets, powers)`` keeps."""
    def run(batches):
        powers = grams.Powers()
        for batch in batches:
            for lo, hi, data, offsets in grams.chunks(batch.column("text")):
                yield batch.slice(lo, hi - lo).filter(pa.array(fn(data, offsets, powers)))

    return docs.mapInArrow(run, docs.schema)
