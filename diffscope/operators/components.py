"""Connected components by union-find inside tasks and contraction between them.

Small graphs (at most `limit` edges, after each task has dropped the edges that its own union-find finds redundant) are
solved by one union-find in one task of that bounded size. Larger ones are contracted first: every node takes the label of
the least hash among itself and its neighbours, edges are rewritten to labels, and loops and repeats vanish. Each round
costs one minimum per node (combined before the shuffle, so a hub is no single task) and two joins, and leaves about half
of the nodes, whatever the diameter: a chain of any length shrinks as fast as a star.

Defined cases: loops and repeated edges are allowed, null ends are a node of their own, no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1_000_000  # edges of one union-find: about 100 MB in a worker


def _values(column: pa.Array) -> list:
    """Python values that can be keys; those of a struct as tuples."""
    found = column.to_pylist()
    return [x if x is None else tuple(x.values()) for x in found] if pa.types.is_struct(column.type) else found


class Forest:
    """Union-find over any hashable values, by path halving."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        if x not in parent:
            parent[x] = x
            return x
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    def join(self, x, y) -> bool:
        """Unite the groups of x and y; false if they are one already."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[y] = x
        return x != y


def spanning(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Of the edges (u, v) of each task only loops and those that join groups, starting anew after `limit` edges."""

    def run(batches):
        forest, seen = Forest(), 0
        for b in batches:
            if (seen := seen + b.num_rows) > limit:
                forest, seen = Forest(), b.num_rows
            keep = [u == v or forest.join(u, v) for u, v in zip(_values(b.column(0)), _values(b.column(1)))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _solved(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph that fits in one task."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        forest, arrow = Forest(), None
        for b in batches:
            arrow = b.schema.field(0).type
            for u, v in zip(_values(b.column(0)), _values(b.column(1))):
                forest.join(u, v)
        nodes = list(forest.parent)
        for low in range(0, len(nodes), 10_000):
            part = nodes[low:low + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, arrow), pa.array([forest.find(x) for x in part], arrow)], ["node", "root"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, f"node {kind}, root {kind}")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) of all nodes, and the edges between labels."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def rank(c: str):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))

    label = both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u")))["x"].alias("label")).select(
        F.col("u").alias("node"), "label")
    ends = edges
    for end in ("u", "v"):
        names = label.select(F.col("node").alias("_node"), F.col("label").alias(f"_{end}"))
        ends = ends.join(names, F.col(end).eqNullSafe(F.col("_node"))).drop("_node")
    return label, ends.where(~F.col("_u").eqNullSafe(F.col("_v"))).select(
        F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct()


def connected(edges: DataFrame, written: Callable[[DataFrame], DataFrame], limit: int = LIMIT, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the undirected edges (u, v); root is the least node of the component (null last).

    `written` materialises a DataFrame in the shared folder and reads it back.
    """
    now, levels = written(spanning(edges, limit)), []
    while now.count() > limit:
        if len(levels) == rounds:
            raise RuntimeError("components did not settle")
        label, next_edges = _contracted(now)
        levels.append(written(label))
        now = written(spanning(next_edges, limit))
    found = written(_solved(now))
    for label in reversed(levels):  # labels without edges left are components
        root = found.withColumnRenamed("node", "_label")
        found = label.join(root, F.col("label").eqNullSafe(F.col("_label")), "left").select(
            "node", F.when(F.col("_label").isNull() & F.col("root").isNull(), F.col("label")).otherwise(F.col("root")).alias("root"))
    if levels:
        found = written(found)
    least = found.groupBy("root").agg(F.min("node").alias("least")).withColumnRenamed("root", "_root")
    return found.join(least, F.col("root").eqNullSafe(F.col("_root"))).select("node", F.col("least").alias("root"))
