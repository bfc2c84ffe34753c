"""WARC archives written and read back by boundary-chain verification.

Writing: a record is one line of Spark's text writer, whose line separator is
the blank lines that end a record, so archives are plain ``WARC/1.1`` files put
in place by Spark's committer.  Payloads that occur before are ``revisit``
records without a body.

Reading: Spark's text reader splits the archives at the magic line, wherever it
stands, over any byte ranges ("blocks").  Each piece is a candidate record; its
header tells the offset of its successor.  Inside a block a task composes these
links; between blocks pointer jumping from the start of each file finds the
entry of every block.  A second pass walks from the entries, so that a magic
line inside a payload never starts a record; records cut by such lines or by a
block's end are put together again.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.llm.store import shared_folder, shared_table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Blocks whose entries are broadcast at once; more are read file group by file group.
BLOCKS_AT_ONCE = 1 << 16
EMPTY_DATE = "1970-01-01T00:00:00Z"


def _urn(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def _first_copies(pages: DataFrame, least: int) -> DataFrame:
    """Digest and smallest page of payloads of ``least`` bytes that repeat."""
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return (rows.where(F.octet_length("payload") >= least).groupBy(F.sha2("payload", 256).alias("digest"))
            .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n"))


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """One record for each row of ``pages`` (page_id, url, html) below ``path``.

    The payload is the html in UTF-8 (null: empty).  Of equal payloads of
    ``least`` bytes or more the smallest page_id has the response, all others
    revisit it; rows that repeat that page_id with that payload are responses
    too.  A null page_id comes after all others; a null url is written as a name
    made of the page.  Control characters and spaces of a url are escaped.  Other
    columns are not read.  Payloads are not shuffled while the table of repeated
    digests is small enough for Spark to broadcast by itself.
    """
    first = shared_table(_first_copies(pages, least))
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    rows = rows.join(first, "digest", "left").withColumn("again", F.coalesce(F.col("first") < F.col("page"), F.col("first").isNotNull() & F.col("page").isNull()))
    uri = F.coalesce(F.expr(r"regexp_replace(url, '[\\x00-\\x20\\x7F<>]', '%20')"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page").cast("string"), F.lit("none"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(~F.col("again"), F.col("html")).otherwise(""))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = [line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), line("WARC-Record-ID", _urn(F.col("page"), F.col("digest"))),
            line("WARC-Target-URI", uri), line("WARC-Date", F.lit(EMPTY_DATE)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(F.col("again"), F.concat(line("WARC-Refers-To", _urn(F.col("first"), F.col("digest"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string"))]
    text = rows.withColumn("block", block).select(F.concat(F.lit(MAGIC), *head, F.lit("\r\n"), F.col("block")).alias("value"))
    text.write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, paths: str | list[str], magic: str) -> DataFrame:
    """What lies between magic lines: file, block, bytes, bytes of the header
    and of the whole record that it would begin (null where it has no header)."""
    raw = spark.read.option("lineSep", magic).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    head = F.when(F.locate(END, F.col("value")) > 0, F.substring_index("value", END, 1))
    raw = raw.withColumn("head", head)
    body = F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1)
    return raw.select("file", "block", "value", F.octet_length("value").cast("long").alias("size"), F.octet_length("head").cast("long").alias("head"),
                      F.nullif(body, F.lit("")).cast("long").alias("body"))


def _record_bytes(magic: int, head: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Bytes from a magic line to the successor; -1 without a usable header."""
    return np.where((head >= 0) & (body >= 0), magic + head + body + 2 * len(END), -1)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(-1).to_numpy(zero_copy_only=False)


def _runs(batches):
    """Runs of rows of one block, in the order of the file: key, whether the
    block begins with this run, batch, first row, row after the last."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        code = file.indices.to_numpy()
        cut = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
        for lo, hi in zip(np.append(0, cut), np.append(cut, batch.num_rows)):
            key = (file.dictionary[code[lo]].as_py(), int(block[lo]))
            yield key, key != held, batch, int(lo), int(hi)
            held = key


def _link(key: tuple[str, int], sizes: list[np.ndarray], lengths: list[np.ndarray], magic: int) -> list[tuple]:
    """A block's candidates with the links inside the block composed: place in
    the block, place where its chain leaves the block (null: it breaks off),
    last candidate of the chain and its end (null: no header), and the bytes of
    the block."""
    size, length = np.concatenate(sizes), np.concatenate(lengths)
    start = np.concatenate([[0], np.cumsum(size + magic)])
    total, at = start[-1], start[:-1] - magic
    if key[1] == 0:  # what stands before the first magic line is no record
        at, length = at[1:], length[1:]
    if not len(at):
        return [(*key, int(total), None, None, None, None)]
    to = np.where(length >= 0, at + length, -magic - 1)
    leaves = to >= total - magic
    after = np.minimum(np.searchsorted(at, to), len(at) - 1)
    inside = ~leaves & (at[after] == to)
    last, hops = np.where(inside, after, np.arange(len(at))), 0
    while hops < len(at).bit_length():
        last, hops = last[last], hops + 1
    return [(*key, int(total), int(a), int(to[z]) if leaves[z] else None, int(at[z]), int(to[z]) if length[z] >= 0 else None) for a, z in zip(at, last)]


_LINKS = "file string, block bigint, total bigint, at bigint, leaves bigint, last bigint, ends bigint"


def candidate_links(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """Candidate records of all blocks, each with the place where its chain
    leaves its block; places count from the block's first whole piece."""
    width = len(magic.encode())

    def run(batches):
        key, sizes, lengths, out = None, [], [], []
        kinds = pa.schema([("file", pa.string()), *[(c, pa.int64()) for c in ("block", "total", "at", "leaves", "last", "ends")]])

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kinds)], schema=kinds)

        for now, begins, batch, lo, hi in _runs(batches):
            if begins and key is not None:
                out += _link(key, sizes, lengths, width)
                sizes, lengths = [], []
                if len(out) > 20_000:
                    yield flush()
                    out = []
            key = now
            sizes.append(_numbers(batch, "size")[lo:hi])
            lengths.append(_record_bytes(width, _numbers(batch, "head")[lo:hi], _numbers(batch, "body")[lo:hi]))
        if key is not None:
            out += _link(key, sizes, lengths, width)
        if out:
            yield flush()

    return _pieces(spark, path, magic).select("file", "block", "size", "head", "body").mapInArrow(run, _LINKS)


def _reachable(edges: DataFrame, start: DataFrame, longest: int) -> DataFrame:
    """Nodes reached from ``start`` in at most ``longest`` steps, by pointer
    jumping: each round doubles the length of all pointers."""
    reached, jump = start, edges
    for k in range(math.ceil(math.log2(max(longest, 1)))):
        step = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        reached = shared_table(reached.union(step).distinct())
        if 2 << k < longest:
            over = jump.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
            jump = shared_table(jump.join(over, ["file", "to"]).select("file", "off", F.col("far").alias("to")))
    return reached


def block_entries(links: DataFrame) -> DataFrame:
    """Blocks with what a reader has to know: ``base`` (offset of the first
    whole piece), ``entry`` (first reachable record that begins in the block)
    and ``owner`` (record that reaches into it from before) with its end
    ``until``."""
    order = Window.partitionBy("file").orderBy("block")
    blocks = links.groupBy("file", "block").agg(F.max("total").alias("total"))
    blocks = shared_table(blocks.withColumn("base", F.sum("total").over(order) - F.col("total")).drop("total"))
    nodes = links.where("at is not null").join(blocks, ["file", "block"]).select(
        "file", "block", (F.col("base") + F.col("at")).alias("off"), (F.col("base") + F.col("leaves")).alias("to"), F.struct((F.col("base") + F.col("last")).alias("at"), (F.col("base") + F.col("ends")).alias("ends")).alias("last"))
    start = nodes.where("off = 0").select("file", "off")
    wanted = nodes.where("to is not null").select("file", F.col("to").alias("off")).union(start).distinct()
    nodes = shared_table(nodes.join(wanted, ["file", "off"], "left_semi"))
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached = _reachable(nodes.where("to is not null").select("file", "off", "to"), nodes.where("off = 0").select("file", "off"), most)
    entries = nodes.join(reached, ["file", "off"], "left_semi").select("file", "block", F.col("off").alias("entry"), "last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.join(entries, ["file", "block"], "left").withColumn("held", F.last("last", True).over(before))
    return found.select("file", "block", "base", "entry", F.col("held.at").alias("owner"), F.col("held.ends").alias("until"))


def _owned(spark: SparkSession, paths, blocks: DataFrame, magic: str) -> DataFrame:
    """Pieces with the record that each belongs to: its offset, the piece's own
    offset and whether the piece is the whole record."""
    width = len(magic.encode())
    schema = "file string, owner bigint, off bigint, whole boolean, value string, head bigint, body bigint"

    def run(batches):
        place = entry = owner = until = -1
        for _, begins, batch, lo, hi in _runs(batches):
            if begins:
                place, entry, owner, until = (int(_numbers(batch, c)[lo]) for c in ("base", "entry", "owner", "until"))
            part = batch.slice(lo, hi - lo)
            size, owners, whole = _numbers(part, "size"), np.empty(hi - lo, np.int64), np.zeros(hi - lo, bool)
            at = np.concatenate([[0], np.cumsum(size + width)[:-1]]) + place - width
            place += int((size + width).sum())
            length = _record_bytes(width, _numbers(part, "head"), _numbers(part, "body"))
            for i, (a, n, s) in enumerate(zip(at.tolist(), length.tolist(), size.tolist())):
                if a == entry and n >= 0:
                    owner, entry, until, whole[i] = a, a + n, a + n, n == s + width
                elif a >= until:  # past the end that the record claims
                    owner = -1
                owners[i] = owner
            keep = pa.array(owners >= 0)
            yield pa.RecordBatch.from_arrays([part.column("file"), pa.array(owners), pa.array(at), pa.array(whole), part.column("value"), part.column("head"), part.column("body")],
                                             names=["file", "owner", "off", "whole", "value", "head", "body"]).filter(keep)

    known = F.broadcast(blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), "base", "entry", "owner", "until"))
    pieces = _pieces(spark, paths, magic)
    return pieces.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b").mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """Records of the archives below ``path`` that are reachable from the start
    of their file: file, offset, head (header lines without the version) and
    block (binary).  A chain that breaks off or ends inside a file gives the
    records before the break; a cut last record is left out.  A folder without
    files, or with empty ones, gives no row."""
    links = shared_table(candidate_links(spark, path, magic))
    blocks = shared_table(block_entries(links))
    n = blocks.count()
    if n <= BLOCKS_AT_ONCE:
        pieces = _owned(spark, path, blocks, magic)
    else:  # files dealt into groups, each with few enough blocks to broadcast
        groups, pieces = -(-n // (BLOCKS_AT_ONCE // 2)), None
        for g in range(groups):
            own = blocks.where(F.pmod(F.xxhash64("file"), F.lit(groups)) == g)
            names = [r["file"] for r in own.select("file").distinct().collect()]
            if names:
                got = _owned(spark, names, own, magic)
                pieces = got if pieces is None else pieces.union(got)
    whole = pieces.where("whole").select("file", F.col("owner").alias("offset"), "value", "head", "body")
    cut = pieces.where("not whole").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"), F.min_by("head", "off").alias("head"),
                                                                F.min_by("body", "off").alias("body"))
    glued = cut.select("file", F.col("owner").alias("offset"), F.array_join(F.col("parts.value"), magic).alias("value"), "head", "body")
    bytes_ = F.col("value").cast("binary")
    return whole.union(glued).select(
        "file", "offset", F.substring_index("value", END, 1).alias("head"), F.substring(bytes_, F.col("head").cast("int") + len(END) + 1, F.col("body").cast("int")).alias("block"),
        "body").where(F.octet_length("block") == F.col("body")).drop("body")


def field(name: str) -> Column:
    """Value of a header line of a record."""
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def captures(records: DataFrame) -> DataFrame:
    """Page, type, digest, length and payload of ``response`` and ``revisit``
    records of :func:`write_archives`; ``intact`` tells whether the payload that
    was read has the digest and length that its header states."""
    page, binary = r"^<urn:page:(-?[0-9]*):", F.col("block")
    http = F.substring_index(binary.cast("string"), END, 1)
    rows = records.withColumn("http", http).select(
        F.nullif(F.regexp_extract(field("WARC-Record-ID"), page, 1), F.lit("")).cast("long").alias("page_id"), field("WARC-Type").alias("record_type"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        F.regexp_extract("http", r"(?i)Content-Length: ([0-9]+)", 1).cast("long").alias("payload_bytes"),
        F.nullif(F.regexp_extract(F.coalesce(field("WARC-Refers-To"), F.lit("")), page, 1), F.lit("")).cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("uri"), F.expr("substring(block, octet_length(http) + 5)").alias("payload"))
    same = (F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    return rows.where("record_type in ('response', 'revisit')").withColumn("intact", F.when(F.col("record_type") == "response", same).otherwise(F.octet_length("payload") == 0))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives in the shared folder, and the captures read
    back from them."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return captures(read_archives(pages.sparkSession, path))
