"""Connected components of a graph given as a table of edges."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.session import cut_lineage, packed

#: Links that a task joins at once; more are joined block by block.
BLOCK = 500_000
#: Links that weigh as much as one row of a wider table when tasks are put together.
LINKS_A_ROW = 4


def _lowest(edges: DataFrame) -> DataFrame:
    """Each edge with the least of ``u`` and all its neighbours.  The minimum is
    combined before the shuffle; the join back is left to adaptive execution,
    which splits the edges of a hub."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def _all_stars(links: DataFrame, fit=lambda df: df) -> bool:
    """Whether each node has one link at most and none leads to a node that has
    one itself: then every link leads to the least node of its component."""
    roles = links.selectExpr("u AS node", "1 AS up", "0 AS down").union(links.selectExpr("v AS node", "0 AS up", "1 AS down"))
    return fit(roles.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _plain(kind: T.DataType) -> bool:
    """Whether values of the type sort in Python as they do in Spark."""
    if isinstance(kind, T.StructType):
        return all(isinstance(f.dataType, (T.IntegralType, T.StringType)) for f in kind.fields)
    return isinstance(kind, (T.IntegralType, T.StringType))


def _values(column: pa.Array) -> list:
    """A column as values to compare; fields that are null come first."""
    if not pa.types.is_struct(column.type):
        return column.to_pylist()
    return list(zip(*[[(x is not None, x) for x in field.to_pylist()] for field in column.flatten()]))


def _joined(pairs) -> dict:
    """Each node of the pairs with the least node it is tied to by them."""
    root = {}

    def top(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in pairs:
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(root)}


def _short(links: DataFrame) -> DataFrame:
    """Links that tie the same nodes, with every block of a task's links joined
    into stars around its least nodes.  It only saves rounds: what blocks of
    different tasks share is left to them, and so are all links of nodes whose
    type sorts otherwise outside Spark."""
    kind = links.schema["u"].dataType
    if not _plain(kind):
        return links

    def run(batches):
        held, n = [], 0

        def stars():
            pairs = [p for batch in held for p in zip(_values(batch.column("u")), _values(batch.column("v")))]
            ties = [(x, y) for x, y in _joined(pairs).items() if x != y]
            arrow = held[0].schema.field("u").type

            def column(values):
                if pa.types.is_struct(arrow):
                    parts = [pa.array([x[i][1] for x in values], f.type) for i, f in enumerate(arrow)]
                    return pa.StructArray.from_arrays(parts, names=[f.name for f in arrow])
                return pa.array(values, arrow)

            return pa.RecordBatch.from_arrays([column([x for x, _ in ties]), column([y for _, y in ties])], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return links.mapInArrow(run, links.schema)


def components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node
    of an edge.  Any type with an order serves as node; edges with a null end
    and loops join nothing (a loop alone still names its node).

    Edges are replaced by links to smaller nodes in two alternating steps: each
    node's larger neighbours, then its smaller ones, are hung on the least node
    around it.  A chain of n nodes shrinks to a star in O(log n) rounds; no
    list of neighbours is ever built and there is no limit on rounds.  Before
    each round a task joins the links that lie in it, so that few are needed.
    ``rows``, the counted edges, lets tasks of a few links be put together.
    """
    def fit(df: DataFrame) -> DataFrame:
        return df if rows is None else packed(df, rows // LINKS_A_ROW)

    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    links = cut_lineage(_short(fit(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())))
    while not _all_stars(links, fit):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = fit(_lowest(both)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        around = fit(_lowest(large))
        small = around.select("v", "m").union(around.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        links = cut_lineage(_short(fit(small)))
    return fit(nodes.join(links, "u", "left")).select(F.col("u").alias("node"), F.coalesce("v", "u").alias("label"))
