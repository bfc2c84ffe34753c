"""Trie of conversation prefixes by bursting containers.

A conversation is a sequence of turn ids (one hash for each different role and
text).  All conversations start in one container under the root.  A container
that holds too many is burst: the turns that its members share become a trie
head, members that end there stay at it, and the others move into containers by
their next turn id.  Containers that are small enough are sorted and swept into
nodes, each inside one task; the heads' figures are then summed up from the
containers below them, burst by burst.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.store import shared_table

#: Hexadecimal characters of a turn id.
ID = 32
#: Ids a chunk of the list of members that end at a head may hold.
CHUNK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NUMBERS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids (turn ids, one after the other), sizes (code points of each
    turn's text).  Turns come by ``turn`` (null first), ties by their turn id;
    a null role or text counts as empty, rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", named.alias("id"), F.length(text).alias("size")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.array_join("t.id", "").alias("ids"), F.col("t.size").alias("sizes"))


def with_heads(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation
    c - c % every, h = crc32 of c's decimal form % most."""
    h, n = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"), F.lit(most - 1)
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("from"), F.substring("ids", 1, (most - 1) * ID).alias("first_ids"), F.slice("sizes", 1, n).alias("first_sizes"))
    rows = own.withColumn("h", h).withColumn("from", F.col("conv_id") - F.col("conv_id") % every).join(first, "from", "left")
    ids = F.concat(F.expr(f"substring(coalesce(first_ids, ''), 1, h * {ID})"), F.expr(f"substring(ids, h * {ID} + 1)"))
    sizes = F.concat(F.slice(F.coalesce("first_sizes", F.array().cast("array<int>")), 1, F.col("h")), F.slice("sizes", F.col("h") + 1, F.size("sizes")))
    return rows.select("conv_id", ids.alias("ids"), sizes.alias("sizes"))


def _shared(a: str, b: str) -> int:
    """Turns that two sequences have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // ID
    x, y = (np.frombuffer(s[:n].encode(), np.uint8) for s in (a, b))
    return int((x != y).argmax()) // ID


def _chain(top: int, bottom: int, sizes: np.ndarray, low: int, n: int, kids: int, leaves: int, saved: int, sha: str) -> dict:
    """Columns of the nodes of depth ``top`` to ``bottom`` that have the same
    members; the last one has ``kids`` children, whose subtrees save ``saved``.
    The first one's parent is still open."""
    depth = np.arange(top, bottom + 1)
    size = np.zeros(len(depth), np.int64)
    size[depth > 0] = sizes[depth[depth > 0] - 1]
    one = np.ones(len(depth), np.int64)
    kid = one.copy()
    kid[-1] = kids
    return {"conv_id": one * low, "depth": depth, "parent_conv_id": one * low, "n_convs": one * n, "n_children": kid, "n_leaves": one * leaves,
            "saved_tokens": saved + (n - 1) * np.cumsum(size[::-1])[::-1], "ends_sha256": [EMPTY_SHA] * (len(depth) - 1) + [sha]}


class _Run:
    """Nodes of depth ``top`` to ``bottom`` that have the same members so far."""

    __slots__ = ("top", "bottom", "sizes", "n", "low", "kids", "leaves", "saved", "sha", "below")

    def __init__(self, top: int, bottom: int, sizes: np.ndarray) -> None:
        self.top, self.bottom, self.sizes = top, bottom, sizes  # sizes of a whole sequence
        self.n = self.kids = self.leaves = self.saved = 0
        self.low, self.sha, self.below = None, None, []

    def take(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(low, self.low)


class Sweep:
    """Nodes of one container from its members, which come in the order of
    their ids and, where these are equal, of conv_id.  The stack holds the path
    of the last member, cut where members part."""

    def __init__(self, top: int) -> None:
        self.top, self.stack, self.out, self.last = top, [], [], ""

    def add(self, conv: int, ids: str, sizes: np.ndarray) -> None:
        n = len(ids) // ID
        if self.stack:
            self._close(_shared(self.last, ids))
        start = self.stack[-1].bottom + 1 if self.stack else self.top
        if start <= n:
            self.stack.append(_Run(start, n, sizes))
        end, self.last = self.stack[-1], ids
        end.take(1, conv)
        if end.sha is None:
            end.sha = hashlib.sha256(str(conv).encode())
        else:
            end.sha.update(f",{conv}".encode())

    def _close(self, depth: int) -> None:
        """End all nodes deeper than ``depth``."""
        while self.stack and self.stack[-1].top > depth:
            run = self.stack.pop()
            self._finish(run, self.stack[-1] if self.stack else None)
        if self.stack and self.stack[-1].bottom > depth:
            run = self.stack.pop()
            upper, run.top = _Run(run.top, depth, run.sizes), depth + 1
            self._finish(run, upper)
            self.stack.append(upper)

    def _finish(self, run: _Run, parent: _Run | None) -> None:
        leaves = run.leaves or 1
        rows = _chain(run.top, run.bottom, run.sizes, run.low, run.n, run.kids, leaves, run.saved, run.sha.hexdigest() if run.sha else EMPTY_SHA)
        for other in run.below:
            other["parent_conv_id"][0] = run.low
        self.out.append(rows)
        if parent:
            parent.take(run.n, run.low)
            parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + int(rows["saved_tokens"][0])
            parent.below.append(rows)

    def nodes(self) -> list[dict]:
        """All runs of nodes; the last one begins with the container's top."""
        self._close(self.top - 1)
        return self.out


def _batch(runs: list[dict], tops: list[tuple[int, str | None, int | None]]) -> pa.RecordBatch:
    """Rows of ``runs``; ``tops`` names the runs that begin a container, the
    burst that this hangs below and the conv_id of the node there."""
    at = np.cumsum([0] + [len(r["depth"]) for r in runs])
    columns = {c: np.concatenate([r[c] for r in runs]) for c in _NUMBERS}
    burst, no_parent = np.full(at[-1], None, object), np.zeros(at[-1], bool)
    for i, name, up in tops:
        burst[at[i]], no_parent[at[i]] = name, up is None
        columns["parent_conv_id"][at[i]] = -1 if up is None else up
    arrays = [pa.array(columns[c], mask=no_parent if c == "parent_conv_id" else None) for c in _NUMBERS]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([x for r in runs for x in r["ends_sha256"]]), pa.array(burst.tolist(), pa.string())], names=[*_NUMBERS, "ends_sha256", "burst"])


def _sweep(containers: DataFrame) -> DataFrame:
    """Nodes of all members' containers; ``burst`` is set on each top."""
    def run(batches):
        held, sweep, runs, tops, rows = None, None, [], [], 0

        def close():
            found = sweep.nodes()
            tops.append((len(runs) + len(found) - 1, held[1], held[2]))
            runs.extend(found)
            return sum(len(r["depth"]) for r in found)

        for batch in batches:
            key, burst, top, up, conv, ids = (batch.column(c).to_pylist() for c in ("key", "burst", "top", "up", "conv_id", "ids"))
            sizes = batch.column("sizes")
            ends, flat = sizes.offsets.to_numpy(), sizes.values.to_numpy()
            for i, k in enumerate(key):
                if held is None or k != held[0]:
                    if held is not None:
                        rows += close()
                        if rows > 20_000:
                            yield _batch(runs, tops)
                            runs, tops, rows = [], [], 0
                    held, sweep = (k, burst[i], up[i]), Sweep(top[i])
                sweep.add(conv[i], ids[i], flat[ends[i]:ends[i + 1]])
        if held is not None:
            close()
            yield _batch(runs, tops)

    return containers.repartition("key").sortWithinPartitions("key", "ids", "conv_id").mapInArrow(run, f"{NODE}, burst string")


def _head_nodes(heads: DataFrame) -> DataFrame:
    """Nodes of trie heads: the turns that a burst container's members share."""
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            runs = [_chain(r["top"], r["bottom"], np.concatenate([np.zeros(max(r["top"] - 1, 0), np.int64), np.array(r["sizes"], np.int64)]), r["low"], r["n"], r["kids"],
                           r["leaves"] or 1, r["saved"], r["sha"] or EMPTY_SHA) for r in rows]
            if rows:
                yield _batch(runs, [(i, r["burst"], r["up"]) for i, r in enumerate(rows)])

    return heads.mapInArrow(run, f"{NODE}, burst string")


def _heads(large: DataFrame) -> DataFrame:
    """One row for each container to burst: its members' number and smallest id
    and the depth down to which they share all turns."""
    # The least and the greatest sequence share what all share.
    found = large.groupBy("key").agg(F.first("burst").alias("burst"), F.first("top").alias("top"), F.first("up").alias("up"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"),
                                     F.min("ids").alias("a"), F.max("ids").alias("b"), F.min_by("sizes", "ids").alias("sizes"))
    kinds = "key string, burst string, top int, up bigint, n bigint, low bigint, bottom int, sizes array<int>"

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["bottom"] = _shared(r.pop("a"), r.pop("b"))
                r["sizes"] = r["sizes"][max(r["top"] - 1, 0):r["bottom"]]
            kind = [("key", pa.string()), ("burst", pa.string()), ("top", pa.int32()), ("up", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("bottom", pa.int32()), ("sizes", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kind))

    return found.mapInArrow(run, kinds)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """Hash of the ids of each head's own members.  Ids are listed in chunks of
    a bounded range first, so the task that hashes a busy head reads few rows
    and holds one at a time."""
    chunk = F.col("conv_id") - F.pmod("conv_id", F.lit(CHUNK))
    listed = ends.groupBy("key", chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        held, sha = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == held:
                    sha.update(f",{ids}".encode())
                    continue
                if held is not None:
                    out.append((held, sha.hexdigest()))
                held, sha = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "sha"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([sha.hexdigest()])], names=["key", "sha"])

    return listed.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(run, "key string, sha string")


def nodes(members: DataFrame, limit: int = 512) -> DataFrame:
    """Nodes of the trie over ``members`` (conv_id, ids, sizes; conv_id is
    unique): smallest member, depth, parent's smallest member, members,
    children, childless nodes of the subtree, tokens saved in the subtree, and
    the hash of the members that end at the node.

    ``limit`` is the number of members beyond which a container is burst; the
    result does not depend on it.  No members give no node, not even the root.
    """
    live = shared_table(members.select(F.lit("").alias("key"), F.lit(None).cast("string").alias("burst"), F.lit(0).alias("top"), F.lit(None).cast("bigint").alias("up"), "conv_id", "ids", "sizes"))
    small, heads, ends = [], [], []
    while True:
        over = shared_table(live.groupBy("key").agg(F.count(F.lit(1)).alias("over")).where(F.col("over") > limit))
        if over.isEmpty():
            small.append(live)
            break
        marked = live.join(over, "key", "left")
        small.append(marked.where("over is null").drop("over"))
        large = marked.where("over is not null").drop("over")
        heads.append(shared_table(_heads(large)))
        cut = large.select("key", "conv_id", "ids", "sizes").join(heads[-1].select("key", "bottom", "low"), "key")
        turns = F.length("ids") / ID
        ends.append(cut.where(turns == F.col("bottom")).select("key", "conv_id"))
        on = cut.where(turns > F.col("bottom"))
        live = shared_table(on.select(F.md5(F.expr(f"substring(ids, 1, (bottom + 1) * {ID})")).alias("key"), F.col("key").alias("burst"), (F.col("bottom") + 1).alias("top"),
                                      F.col("low").alias("up"), "conv_id", "ids", "sizes"))
    found = _sweep(_union(small))
    if not heads:
        return found.drop("burst")
    found = shared_table(found)
    sha = shared_table(_end_hashes(_union(ends)))
    made, tops = [found], found.where("burst is not null").select("burst", "n_leaves", "saved_tokens")
    for head in reversed(heads):  # the last burst first: its containers are all swept
        below = tops.groupBy(F.col("burst").alias("key")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        full = head.join(below, "key", "left").join(sha, "key", "left").fillna(0, ["kids", "leaves", "saved"])
        made.append(shared_table(_head_nodes(full)))
        tops = tops.union(made[-1].where("burst is not null").select("burst", "n_leaves", "saved_tokens"))
    return _union(made).drop("burst")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def prefix_trie(turns: DataFrame, limit: int = 512) -> DataFrame:
    """Trie nodes of ``turns`` (conv_id, turn, role, text), whose conversations
    are first given the opening turns of the first one of their hundred.  Null,
    repeated and tied turns: see :func:`sequences`; an exact copy of a row is a
    turn of its own.  Other columns are not read."""
    return nodes(with_heads(sequences(turns)), limit)
