"""Join of texts whose sets of word n-grams have a high Jaccard similarity, by
count-vector R-trees.

1. Texts with one set are one class.  Two classes that link share a gram among
   the first ``n - ceil(t * n) + 1`` grams of each in a common order (grams seen
   often in a bounded sample come last), so the join falls into one block for
   each such gram.  Blocks with the same members are kept once, with their number.
2. In a block, a class is a point: its grams are hashed into groups, and the
   counts by group are the coordinates.  The sum of the coordinate minima of two
   points bounds the overlap of their sets; an R-tree bounds whole boxes alike.
3. The trees give every class its best partner by bound in another component
   (at first each class is its own); these pairs are verified on the sets, and
   verified links merge components, which mostly halves those of a group of
   near copies each time.  After a few such ``rounds`` the trees are
   searched for all pairs that the bound allows and that still lie in different
   components; these are verified too.  No link that could join two components
   is left out; links inside a component decide nothing.

A block of many points is cut into tiles (every pair of tiles is searched), so
neither a task nor the driver holds a whole block.
"""
from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import grams, samples
from rostrum.llm.store import shared_table, shuffles_removed
from rostrum.operators.components import components
from rostrum.session import packed

COARSE_BITS, FINE_BITS = 4, 8
LEAF = 32
TILE = 1_024
BROADCAST_ROWS = 500_000


def text_sets(data: np.ndarray, offsets: np.ndarray, powers: grams.Powers, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``k`` words, ASCII letters
    lower-cased; fewer words are one run, no word is an empty set."""
    words = grams.Words(grams.LOWER[data], offsets, grams.NOT_SPACE, powers)
    h, _ = grams.shingles(words, k)
    n = words.counts
    at = np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
    out = []
    for i, c in enumerate(n.tolist()):
        if c >= k:
            out.append(np.unique(h[at[i]:at[i + 1]]))
        else:
            part = words.hash[words.first[i]:words.first[i + 1]]
            out.append(grams.row_hash([part[j:j + 1] for j in range(c)]) + np.uint64(c) if c else part)
    return out


def digest(s: np.ndarray) -> int:
    return struct.unpack("<q", hashlib.blake2b(s.tobytes(), digest_size=8).digest())[0] if len(s) else 0


def prefix(s: np.ndarray, percent: int, hot: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """The grams of which a linking set must share one."""
    size = len(s) - -(-percent * len(s) // 100) + 1
    often = np.flatnonzero(sieve[s >> np.uint64(44)])
    if len(often) and len(hot):
        at = np.minimum(np.searchsorted(hot, s[often]), len(hot) - 1)
        often = often[hot[at] == s[often]]
        if len(often):
            rare = np.ones(len(s), bool)
            rare[often] = False
            return np.concatenate([s[rare], s[often]])[:size]
    return s[:size]


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the set's grams by hash group; one or two grams a group, so that
    the bound is sharp, until a set has more grams than 256 groups allow."""
    bits = min(FINE_BITS, max(COARSE_BITS, (len(s) // 2).bit_length()))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def pack_point(p: np.ndarray) -> bytes:
    """Half a byte a count where all fit, else one or four; the first byte tells."""
    most = p.max(initial=0)
    if most < 16:
        return b"\2" + (p[::2] | p[1::2] << 4).astype(np.uint8).tobytes()
    return b"\1" + p.astype(np.uint8).tobytes() if most < 256 else b"\0" + p.astype(np.uint32).tobytes()


def unpack_point(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8 if b[0] else np.uint32, offset=1)
    return (np.stack([raw & 15, raw >> 4], 1).ravel() if b[0] == 2 else raw).astype(np.int64)


def _folded(p: np.ndarray, bits: int) -> np.ndarray:
    return p.reshape(1 << bits, -1).sum(1)


class Tree:
    """R-tree over points: leaves of boxes packed by size, then by the coarse
    counts.  A box has the greatest coordinates and the range of sizes."""

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray]) -> None:
        self.sizes, self.points = sizes.astype(np.int64), points
        self.coarse = np.stack([_folded(p, COARSE_BITS) for p in points]).astype(np.int64)
        # Sort-tile packing: strips by size, inside a strip by the heaviest coordinate's counts.
        strip = np.argsort(np.argsort(self.sizes, kind="stable"), kind="stable") // (LEAF * 8)
        spread = self.coarse.var(0).argmax()
        self.order = np.lexsort([self.coarse[:, spread], strip])
        self.at = np.arange(0, len(points), LEAF)
        rows = self.coarse[self.order]
        self.high = np.maximum.reduceat(rows, self.at)
        self.least = np.minimum.reduceat(self.sizes[self.order], self.at)
        self.most = np.maximum.reduceat(self.sizes[self.order], self.at)

    def leaf(self, i: int) -> np.ndarray:
        return self.order[self.at[i]:self.at[i] + LEAF]


def _needed(a, b, percent: int):
    """Least overlap of two linking sets of these sizes (as a fraction's top;
    compare with ``(100 + percent) * overlap``)."""
    return percent * (a + b)


def candidate_pairs(x: Tree, y: Tree, percent: int, apart=None):
    """Pairs (row of x, row of y) whose bound allows a link, leaf pair by leaf
    pair; ``apart(i, j)`` may exclude pairs before the finer bound."""
    same = x is y
    for i in range(len(x.at)):
        box = np.minimum(x.high[i], y.high).sum(1)
        fits = ((100 + percent) * box >= _needed(x.least[i], y.least, percent)) & \
               (100 * x.most[i] >= percent * y.least) & (100 * y.most >= percent * x.least[i])
        a = x.leaf(i)
        for j in np.flatnonzero(fits):
            if same and j < i:
                continue
            b = y.leaf(j)
            p, q = np.repeat(a, len(b)), np.tile(b, len(a))
            keep = p < q if same and j == i else np.ones(len(p), bool)
            sp, sq = x.sizes[p], y.sizes[q]
            keep &= (100 * np.minimum(sp, sq) >= percent * np.maximum(sp, sq))
            if apart is not None:
                keep &= apart(p, q)
            p, q = p[keep], q[keep]
            keep = (100 + percent) * np.minimum(x.coarse[p], y.coarse[q]).sum(1) >= _needed(x.sizes[p], y.sizes[q], percent)
            p, q = p[keep], q[keep]
            if len(p):
                bound = _fine(x, y, p, q)
                keep = (100 + percent) * bound >= _needed(x.sizes[p], y.sizes[q], percent)
                if keep.any():
                    yield p[keep], q[keep], bound[keep]


def _fine(x: Tree, y: Tree, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of coordinate minima at the finest grouping both points have."""
    level = np.minimum([len(x.points[i]) for i in p], [len(y.points[j]) for j in q])
    out = np.zeros(len(p), np.int64)
    for g in np.unique(level):
        mine, bits = np.flatnonzero(level == g), int(g).bit_length() - 1
        left, li = np.unique(p[mine], return_inverse=True)
        right, ri = np.unique(q[mine], return_inverse=True)
        m = np.stack([_folded(x.points[i], bits) for i in left])
        w = np.stack([_folded(y.points[j], bits) for j in right])
        for s in range(0, len(mine), 4096):
            part = slice(s, s + 4096)
            out[mine[part]] = np.minimum(m[li.ravel()[part]], w[ri.ravel()[part]]).sum(1)
    return out


_PAIRS = "a bigint, an bigint, b bigint, bn bigint, w bigint, score double"
_COLUMNS = ["key", "ti", "tj", "side", "cls", "n", "comp_c", "comp_n", "w", "pts"]


def _matrices(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Points of many rows as one matrix for each level: level and row in it."""
    points = [unpack_point(x) for x in packed]
    level = np.array([len(x).bit_length() - 1 for x in points], np.int64)
    at, out = np.zeros(len(points), np.int64), {}
    for g in np.unique(level).tolist():
        mine = np.flatnonzero(level == g)
        at[mine] = np.arange(len(mine))
        out[g] = np.stack([points[i] for i in mine])
    return level, at, out


def _short_blocks(col: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray, percent: int):
    """Pairs of all blocks that are one leaf, together: the same bounds as in
    the tree, with no box above the points."""
    rows = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    within = rows - np.repeat(start, size)
    after = np.repeat(size, size) - 1 - within
    p = np.repeat(rows, after)
    q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(after) - after, after)
    n = col["n"]
    keep = 100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])
    keep &= (col["comp_c"][p] != col["comp_c"][q]) | (col["comp_n"][p] != col["comp_n"][q])
    p, q = p[keep], q[keep]
    if not len(p):
        return p, q, np.zeros(0, np.int64)
    used, back = np.unique(np.concatenate([p, q]), return_inverse=True)
    level, at, made = _matrices(col["pts"][used])
    i, j = back.ravel()[:len(p)], back.ravel()[len(p):]
    bound, low = np.zeros(len(p), np.int64), np.minimum(level[i], level[j])
    for g in np.unique(low).tolist():
        folded = {h: m.reshape(len(m), 1 << g, -1).sum(2) for h, m in made.items() if h >= g}
        for x in np.unique(level[i][low == g]).tolist():
            for y in np.unique(level[j][low == g]).tolist():
                mine = np.flatnonzero((low == g) & (level[i] == x) & (level[j] == y))
                for s in range(0, len(mine), 8192):
                    part = mine[s:s + 8192]
                    bound[part] = np.minimum(folded[x][at[i[part]]], folded[y][at[j[part]]]).sum(1)
    keep = (100 + percent) * bound >= _needed(n[p], n[q], percent)
    return p[keep], q[keep], bound[keep]


def _best_of_each(p: np.ndarray, q: np.ndarray, score: np.ndarray):
    """Of each row the partner with the greatest bound relative to the sizes."""
    p, q, score = np.concatenate([p, q]), np.concatenate([q, p]), np.tile(score, 2)
    order = np.lexsort([q, -score, p])
    best = order[np.flatnonzero(np.diff(p[order], prepend=-1))]
    return p[best], q[best], score[best]


def _long_block(col: dict[str, np.ndarray], start: int, stop: int, percent: int):
    """Pairs of one block (or pair of tiles) by its trees."""
    side = col["side"][start:stop]
    left, right = np.flatnonzero(side == 0) + start, np.flatnonzero(side == 1) + start
    if not len(left):
        return []
    comp = np.stack([col["comp_c"], col["comp_n"]], 1)
    x = Tree(col["n"][left], [unpack_point(col["pts"][i]) for i in left])
    y = Tree(col["n"][right], [unpack_point(col["pts"][i]) for i in right]) if len(right) else x
    other = right if len(right) else left
    return [(left[p], other[q], b) for p, q, b in candidate_pairs(x, y, percent, lambda p, q: (comp[left[p]] != comp[other[q]]).any(1))]


def _search(blocks: DataFrame, rows: int, percent: int, nearest: bool) -> DataFrame:
    """Pairs of classes that the bounds allow, from about ``rows`` rows dealt and
    sorted by block.  ``nearest`` keeps each class's best partner, else all pairs.

    A pair's blocks also bound its overlap: all common grams that lie in the
    first grams of the set whose first grams end earlier are blocks of both, and
    ``w`` says for how many grams a block stands.
    """
    def run(batches):
        held: list = []

        def cut(tables, final):
            table = pa.Table.from_batches(tables).combine_chunks()
            col = {c: table.column(c).to_numpy(zero_copy_only=False) if c == "pts" else table.column(c).to_numpy() for c in _COLUMNS}
            turn = np.zeros(len(col["key"]), bool)
            turn[0] = True
            for c in ("key", "ti", "tj"):
                turn[1:] |= col[c][1:] != col[c][:-1]
            start = np.flatnonzero(turn)
            size = np.diff(np.append(start, len(turn)))
            if not final:
                rest = table.slice(int(start[-1])).to_batches()
                start, size = start[:-1], size[:-1]
            short = (size > 1) & (size <= LEAF) & (col["ti"][start] == col["tj"][start])
            found = [_short_blocks(col, start[short], size[short], percent)] if short.any() else []
            for s, m in zip(start[~short & (size > 1)], size[~short & (size > 1)]):
                found += _long_block(col, int(s), int(s + m), percent)
            return col, found, [] if final else rest

        def send(col, found):
            found = [f for f in found if len(f[0])]
            if found:
                p, q, bound = (np.concatenate(c) for c in zip(*found))
                score = bound / (col["n"][p] + col["n"][q])
                if nearest:
                    p, q, score = _best_of_each(p, q, score)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (col["cls"][p], col["n"][p], col["cls"][q], col["n"][q], col["w"][p], score)],
                                                 names=["a", "an", "b", "bn", "w", "score"])

        for batch in batches:
            if batch.num_rows:
                col, found, held = cut([*held, batch], False)
                yield from send(col, found)
        if held:
            col, found, _ = cut(held, True)
            yield from send(col, found)

    # A block lies in one partition, so partitions that are put together do not mix blocks.
    dealt = packed(blocks.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj"), rows)
    pairs = dealt.select(*_COLUMNS).mapInArrow(run, _PAIRS)
    if not nearest:  # one order of the two ends
        flip = "(a > b) or (a = b and an > bn)"
        pairs = pairs.select(*[F.expr(f"if({flip}, {p}, {q})").alias(q) for p, q in (("b", "a"), ("bn", "an"), ("a", "b"), ("an", "bn"))], "w", "score")
    seen = packed(pairs.groupBy("a", "an", "b", "bn").agg(F.sum("w").alias("w"), F.max("score").alias("score")), rows)
    # Grams outside the first ones, plus the blocks they share, must make up the overlap a link needs.
    beyond = F.greatest(*[F.ceil(F.lit(percent) * F.col(c) / 100) - 1 for c in ("an", "bn")])
    lack = F.lit(percent) * (F.col("an") + F.col("bn")) - (100 + percent) * beyond
    if not nearest:
        return seen.where((100 + percent) * F.col("w") >= lack).select("a", "an", "b", "bn")
    # A best partner may change from block to block, so here half the blocks will do: what is
    # passed over is looked at again in the search for all pairs.
    best = F.max(F.struct("w", "score", "b", "bn")).alias("best")
    return packed(seen.where(2 * (100 + percent) * F.col("w") >= lack).groupBy("a", "an").agg(best), rows).select("a", "an", "best.b", "best.bn")


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A hint only for a table whose counted rows keep it small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _hot_grams(docs: DataFrame, k: int, sample: int, often: int) -> np.ndarray:
    """Grams of at least ``often`` different sets among ``sample`` texts."""
    rows = samples.take(docs, docs.select("doc_id", F.lit(0).alias("label")), sample,
                        lambda d, o, p: {"grams": [s.tobytes() for s in text_sets(d, o, p, k)]})
    different = {r["grams"] for r in rows}
    seen, n = np.unique(np.concatenate([np.frombuffer(g, np.uint64) for g in different] or [np.zeros(0, np.uint64)]), return_counts=True)
    return seen[n >= often]


def link(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and
    ``component_id``, the smallest doc_id reachable by links.  Two rows link
    when ``100 * overlap >= percent * union`` of their sets.

    Null text and text without words have no gram and link with nothing: their
    component is their own doc_id.  Rows with a null doc_id link as others do
    but give a component no id (null if it has no other).  Repeated rows are
    copies.  ``sample`` and ``often`` only set the order of grams, on which the
    result doesn't depend.  Other columns are not read.  Options are ``k``
    words a gram, ``percent``, ``sample`` and ``often``, and the most ``rounds`` of
    best partners, on which only the work of the last search depends.
    """
    return _linked(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: the one with
    the smallest doc_id (null last).  Rows without a word all stay.  Only the
    rows that go are joined back; they are broadcast when their count is small."""
    named = shared_table(_linked(docs, **options).where("n > 0"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    groups = named.groupBy("comp_c", "comp_n").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark"))
    gone = named.join(groups, ["comp_c", "comp_n"]).where(~same).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    gone = shared_table(gone)
    repeated = shared_table(named.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")))

    def hit(other):
        return F.col("doc_id").cast("long").eqNullSafe(other["gone_id"]) & (F.xxhash64("text") == other["gone_mark"])

    kept = docs.join(_maybe_broadcast(gone, gone.count()), hit(gone), "left_anti")
    if n := repeated.count():
        few = _maybe_broadcast(repeated, n)
        kept = kept.join(few, hit(repeated), "left_anti").union(kept.join(few, hit(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def _linked(docs: DataFrame, k: int = 5, percent: int = 75, sample: int = 4_096, often: int = 3, rounds: int = 3) -> DataFrame:
    """Per row: doc_id, ``mark`` of the text, ``n`` grams, the component as
    (comp_c, comp_n) and by its smallest doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    hot = _hot_grams(docs, k, sample, often)
    sieve = np.zeros(1 << 20, bool)
    sieve[hot >> np.uint64(44)] = True
    held = spark.sparkContext.broadcast((hot, np.packbits(sieve)))

    def describe(batches):
        powers, told = grams.Powers(), set()
        often_, sieve_ = held.value[0], np.unpackbits(held.value[1]).astype(bool)
        for batch in batches:
            for lo, hi, data, offsets in grams.chunks(batch.column("text")):
                sets = text_sets(data, offsets, powers, k)
                named = [(digest(s), len(s)) for s in sets]
                # A copy in the same task adds no member to any block.
                first = [prefix(s, percent, often_, sieve_).view(np.int64) if len(s) and x not in told and not told.add(x) else None for s, x in zip(sets, named)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "mark")], pa.array([n for _, n in named], pa.int64()), pa.array([d for d, _ in named], pa.int64()),
                     pa.array([pack_point(point(s)) for s in sets], pa.binary()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "mark", "n", "cls", "pts", "first"])

    about = shared_table(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(describe, "doc_id bigint, mark bigint, n bigint, cls bigint, pts binary, first array<bigint>"))
    by_key = Window.partitionBy("key")
    keyed = about.select(F.explode("first").alias("key"), "cls", "n")
    ends = keyed.select("*", F.min("cls").over(by_key).alias("lo"), F.max("cls").over(by_key).alias("hi"))
    members = ends.where("lo <> hi").dropDuplicates(["key", "cls", "n"])
    members = members.select("*", F.count("*").over(by_key).alias("m"), F.expr("bit_xor(xxhash64(cls, n)) over (partition by key)").alias("mark"))
    members = shared_table(members)
    n_members = members.count()
    per_key = packed(members.groupBy("key").agg(*[F.first(c).alias(c) for c in ("lo", "hi", "m", "mark")]), n_members)
    kept = packed(per_key.groupBy("lo", "hi", "m", "mark").agg(F.min("key").alias("key"), F.count("*").alias("w")), n_members).select("key", "w")
    blocks = shared_table(packed(members.join(kept, "key"), n_members).select("key", "cls", "n", "m", "w"))

    # One text of each class in a block stands for it.
    one = about.select("cls", "n", F.struct("doc_id", "pts").alias("x")).groupBy("cls", "n").agg(F.min("x").alias("x")).select("cls", "n", "x.*")
    n_about, n_blocks = about.count(), blocks.count()
    classes = shared_table(packed(one.join(blocks.select("cls", "n").distinct(), ["cls", "n"]), n_about))
    found, links, n_links, before, left = None, None, 0, None, rounds
    while left >= 0:
        nearest = left > 0
        rows = n_blocks if nearest else blocks.agg(F.sum(_tiles())).first()[0] or 0
        pairs = _search(_tiled(blocks, rows, classes, found, not nearest), rows, percent, nearest)
        new = _verified(pairs, docs, classes, k, percent)
        n_new = new.count()
        links, n_links = new if links is None else links.union(new), n_links + n_new
        if n_new or found is None:
            with shuffles_removed(spark):
                found = _components(links, n_links)
        # Groups of near copies still halve; where links get few, another round of partners saves nothing.
        left = 0 if nearest and before is not None and 4 * n_new < before else left - 1
        before = n_new
    return _named(about.drop("pts", "first"), found, n_about)


def _sets(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Sets of the chosen classes, from the text of each one's ``doc_id``."""
    n = chosen.count()
    ids = packed(chosen.select(F.col("doc_id").alias("chosen_id")).distinct(), n)
    texts = docs.join(_maybe_broadcast(ids, n), F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi").select("text")

    def run(batches):
        powers, told = grams.Powers(), set()
        for batch in batches:
            for _, _, data, offsets in grams.chunks(batch.column("text")):
                sets = [s for s in text_sets(data, offsets, powers, k) if len(s)]
                named = [(digest(s), len(s)) for s in sets]
                new = [i for i, x in enumerate(named) if x not in told and not told.add(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([named[i][0] for i in new], pa.int64()), pa.array([named[i][1] for i in new], pa.int64()),
                     pa.array([sets[i].view(np.int64) for i in new], pa.list_(pa.int64()))], names=["cls", "n", "grams"])

    made = texts.mapInArrow(run, "cls bigint, n bigint, grams array<bigint>")
    # A doc_id that is repeated with other texts brings sets that nobody asked for.
    wanted = _maybe_broadcast(chosen.select("cls", "n"), n)
    return shared_table(packed(made.join(wanted, ["cls", "n"], "left_semi").dropDuplicates(["cls", "n"]), n))


def _tiles():
    return F.ceil(F.col("m") / TILE).cast("int")


def _tiled(blocks: DataFrame, n_rows: int, classes: DataFrame, found: DataFrame | None, crossed: bool) -> DataFrame:
    """Rows (``n_rows`` at most) of the blocks of at least two components with
    their points, dealt into tiles.  With ``crossed`` every pair of tiles of a
    block is searched, else each tile by itself."""
    tiles = _tiles()
    known = blocks.withColumns({"comp_c": F.col("cls"), "comp_n": F.col("n")})
    if found is not None:
        known = blocks.join(_maybe_broadcast(found, found.count()), ["cls", "n"], "left").withColumns({"comp_c": F.coalesce("comp_c", "cls"), "comp_n": F.coalesce("comp_n", "n")})
        mixed = known.groupBy("key").agg(F.min(F.struct("comp_c", "comp_n")).alias("x"), F.max(F.struct("comp_c", "comp_n")).alias("y")).where("x <> y")
        known = packed(known.join(mixed.select("key"), "key", "left_semi"), n_rows)
    known = known.withColumns({"tiles": tiles, "own": F.pmod(F.xxhash64("cls", "n"), tiles).cast("int")})
    # A row meets the rows of its own tile and of every other, on one side of the pair.
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)) if crossed else F.col("own")
    rows = known.withColumn("other", other).select(
        "key", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "cls", "n", "comp_c", "comp_n", "w")
    return packed(rows.join(classes.select("cls", "n", "pts"), ["cls", "n"]), n_rows)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose sets do link; only classes of a pair have their set made."""
    pairs = shared_table(pairs)
    n_pairs = pairs.count()
    ends = packed(pairs.select(F.col("a").alias("cls"), F.col("an").alias("n")).union(pairs.select("b", "bn")).distinct(), n_pairs)
    sets = _sets(docs, shared_table(classes.drop("pts").join(_maybe_broadcast(ends, 2 * n_pairs), ["cls", "n"])), k)
    x = sets.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("grams").alias("ga"))
    y = sets.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("grams").alias("gb"))
    both = packed(packed(pairs.join(x, ["a", "an"]), n_pairs).join(y, ["b", "bn"]), n_pairs)
    overlap = F.size(F.array_intersect("ga", "gb"))
    return shared_table(both.where((100 + percent) * overlap >= percent * (F.col("an") + F.col("bn"))).select("a", "an", "b", "bn"))


def _components(links: DataFrame, rows: int) -> DataFrame:
    """Class and the class that names its component, both as two columns."""
    ends = links.select(F.struct(F.col("a").alias("cls"), F.col("an").alias("n")).alias("x"), F.struct(F.col("b").alias("cls"), F.col("bn").alias("n")).alias("y"))
    return shared_table(components(ends, "x", "y", rows).select("node.cls", "node.n", F.col("label.cls").alias("comp_c"), F.col("label.n").alias("comp_n")))


def _named(about: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """Component of each row and its least doc_id."""
    some, none = about.where("n > 0"), about.where("n = 0")
    classes = packed(some.groupBy("cls", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), rows)
    found = _maybe_broadcast(found, found.count())
    linked = classes.join(found, ["cls", "n"])
    least = linked.groupBy("comp_c", "comp_n").agg(F.min("first").alias("least"))
    by_link = linked.join(least, ["comp_c", "comp_n"]).select("cls", "n", "comp_c", "comp_n", "least")
    by_copy = classes.where("copies > 1").join(found, ["cls", "n"], "left_anti").select("cls", "n", F.col("cls").alias("comp_c"), F.col("n").alias("comp_n"), F.col("first").alias("least"))
    # A class that stands alone needs no partner row: its document names itself.
    whole = packed(some.join(by_link.union(by_copy), ["cls", "n"], "left"), rows)
    own = F.when(F.col("comp_c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    whole = whole.select("doc_id", "mark", "n", F.coalesce("comp_c", "cls").alias("comp_c"), F.coalesce("comp_n", "n").alias("comp_n"), own)
    return whole.union(none.select("doc_id", "mark", "n", "cls", "n", F.col("doc_id").alias("component_id")))
