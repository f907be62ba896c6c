"""Distances and shortest-path dependencies of all nodes of many graphs, as sums per node: no table of node pairs.

A breadth-first search from every node of a graph takes (nodes x edges) steps. Graphs of at most `WORK` steps are dealt to
tasks by graph and searched there, many small ones side by side: the state is one cell per node and source, sources go in
slices so that a slice has at most `CELLS` cells and as many steps along edges, and only cells of the current level are
expanded, so a long chain costs its pairs and not its levels times its size. Dependencies (betweenness) are handed back level by level over the same cells.

Larger graphs are searched on the cluster, level by level. For distances a row is a node with 64 sources as the bits of one
number, frontiers are united by `bit_or`, and new bits are counted per node and level; the states of `ROWS` rows are open at
a time. Dependencies of larger graphs take sources in slices as well, with one row per node and open source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.session import written

G = "graph_id"
WORK = 10**9
CELLS = 1 << 18  # cells of a slice, and steps along edges: about 40 MB in a worker
ROWS = 50_000_000
SUMS = ("reached", "total", "raw", "pairs", "length", "longest")


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being a key like any other; the keys come from the left."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(named, [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys], how).drop(*[f"_right_{k}" for k in keys])


class Search:
    """Searches in some graphs side by side: node numbers run on from graph to graph, edges are (source, target) numbers."""

    def __init__(self, sizes: list[int], edges: np.ndarray):
        self.sizes, self.nodes = np.array(sizes), int(sum(sizes))
        self.start = np.cumsum(self.sizes) - self.sizes
        edges = edges[np.argsort(edges[:, 0], kind="stable")]
        self.target = edges[:, 1]
        self.degree = np.bincount(edges[:, 0], minlength=self.nodes)
        self.head = np.cumsum(self.degree) - self.degree

    def _expanded(self, cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each edge out of each cell: the number of the cell and the cell it leads to."""
        node, slot = np.divmod(cells, width)
        degree = self.degree[node]
        which = np.repeat(np.arange(len(cells)), degree)
        edge = np.arange(len(which)) - np.repeat(np.cumsum(degree) - degree, degree) + self.head[node][which]
        return which, self.target[edge] * width + slot[which]

    def run(self, low: int, high: int, dependencies: bool) -> dict[str, np.ndarray]:
        """Per node, over the sources low to high of its graph: reached, total, longest, and with `dependencies` raw."""
        width = max(1, high - low)
        count = np.clip(self.sizes - low, 0, width)
        slot = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        cells = np.sort((np.repeat(self.start + low, count) + slot) * width + slot)
        distance = np.full(self.nodes * width, -1, dtype=np.int32)
        paths = np.zeros(self.nodes * width)
        distance[cells] = 0
        paths[cells] = 1
        levels = [cells]
        out = {name: np.zeros(self.nodes, dtype=np.int64) for name in ("reached", "total", "longest")}
        while len(levels[-1]):
            which, to = self._expanded(levels[-1], width)
            new = distance[to] < 0
            cells, at = np.unique(to[new], return_inverse=True)
            distance[cells] = len(levels)
            if dependencies:
                paths[cells] = np.bincount(at, weights=paths[levels[-1]][which[new]], minlength=len(cells))
            node = np.bincount(cells // width, minlength=self.nodes) if len(cells) else 0
            out["reached"] += node
            out["total"] += len(levels) * node
            if len(cells):
                out["longest"][cells // width] = len(levels)
            levels.append(cells)
        if dependencies:
            raw, handed = np.zeros(self.nodes), np.zeros(self.nodes * width)
            for level in range(len(levels) - 2, -1, -1):
                cells = levels[level]
                which, to = self._expanded(cells, width)
                next_ = distance[to] == level + 1
                which, to = which[next_], to[next_]
                share = paths[cells[which]] / paths[to] * (1 + handed[to])
                handed[cells] = np.bincount(which, weights=share, minlength=len(cells))
                if level:
                    raw += np.bincount(cells // width, weights=handed[cells], minlength=self.nodes)
            out["raw"] = raw
        return out


def _searched(graphs: list[tuple]) -> pa.RecordBatch:
    """Sums of all nodes of the graphs (id, nodes, edges by node name)."""
    names, ids, sizes, edges = [], [], [], []
    for graph, nodes, links in graphs:
        low = len(names)
        ordered = sorted(nodes, key=lambda x: (x is None, x or ""))
        number = {x: low + i for i, x in enumerate(ordered)}
        names += ordered
        ids += [graph] * len(ordered)
        sizes.append(len(ordered))
        edges += [(number[a], number[b]) for a, b in links if a != b]
    directed = np.unique(np.array(edges, dtype=np.int64).reshape(-1, 2), axis=0)
    both = np.unique(np.concatenate((directed, directed[:, ::-1])), axis=0)
    one, two = Search(sizes, directed), Search(sizes, both)
    width = max(1, min(max(sizes), CELLS // max(1, len(names), len(both))))
    sums = {name: np.zeros(len(names), dtype=np.float64 if name == "raw" else np.int64) for name in SUMS}
    for low in range(0, max(sizes), width):
        high = min(low + width, max(sizes))
        a, b = one.run(low, high, True), two.run(low, high, False)
        for name, part in (("reached", a["reached"]), ("total", a["total"]), ("raw", a["raw"]), ("pairs", b["reached"]),
                           ("length", b["total"])):
            sums[name] += part
        np.maximum(sums["longest"], b["longest"], out=sums["longest"])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names, pa.string()), *map(pa.array, sums.values())],
                                      [G, "node", *SUMS])


def _in_tasks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = nodes.select(G, F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(False).alias("edge")).unionByName(
        edges.select(G, "src", "dst", F.lit(True).alias("edge"))).repartition(G).sortWithinPartitions(G)

    def run(batches):
        held: list[tuple] = []
        largest = total = 0
        for graph in graphs(batches):
            n, size = len(graph[1]), len(graph[1]) + 2 * len(graph[2])  # edges are also searched both ways
            if held and (total + size) * max(largest, n) > CELLS:
                yield _searched(held)
                held, largest, total = [], 0, 0
            held.append(graph)
            largest, total = max(largest, n), total + size
        if held:
            yield _searched(held)

    def graphs(batches):
        graph, names, links = None, set(), []
        for b in batches:
            for g, a, z, is_edge in zip(*(c.to_pylist() for c in b.columns)):
                if names and g != graph:
                    yield graph, names, links
                    names, links = set(), []
                graph = g
                names.add(a)
                if is_edge:
                    names.add(z)
                    links.append((a, z))
        if names:
            yield graph, names, links

    return rows.mapInArrow(run, f"{G} string, node string, reached long, total long, raw double, pairs long, length long, "
                                "longest long")


# ------------------------------------------------------------------ graphs too large for a task

def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with `word` and `bit`, their place among the sources: distinct numbers, whatever the partitions."""
    return written(nodes.select(G, "node", F.monotonically_increasing_id().alias("number"))).select(
        G, "node", F.expr("number div 64").alias("word"), F.expr("shiftleft(1L, cast(number % 64 AS int))").alias("bit"))


def _by_words(numbered: DataFrame, edges: DataFrame, words: Column) -> DataFrame:
    """(graph_id, node, dist, new): number of sources of the words that reach each node at each distance."""
    seen = written(numbered.where(words).select(G, "node", "word", F.col("bit").alias("bits")))
    frontier, out, level = seen, [], 0
    while not frontier.isEmpty():
        level += 1
        reached = matched(frontier.withColumnRenamed("node", "src"), edges, [G, "src"]).groupBy(
            G, F.col("dst").alias("node"), "word").agg(F.expr("bit_or(bits)").alias("bits"))
        frontier = written(matched(reached, seen.withColumnRenamed("bits", "old"), [G, "node", "word"], "left").select(
            G, "node", "word", F.expr("bits & ~coalesce(old, 0L)").alias("bits")).where("bits != 0"))
        seen = written(seen.unionByName(frontier).groupBy(G, "node", "word").agg(F.expr("bit_or(bits)").alias("bits")))
        out.append(frontier.groupBy(G, "node").agg(F.sum(F.bit_count("bits")).alias("new")).withColumn("dist", F.lit(level)))
    empty = numbered.select(G, "node", F.lit(0).cast("long").alias("new"), F.lit(0).alias("dist")).limit(0)
    return reduce(DataFrame.unionByName, out, empty)


def _distance_sums(nodes: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """(graph_id, node, reached, total, longest), a slice of words after the other."""
    numbered = written(_numbered(nodes))
    words = numbered.agg(F.count_distinct("word")).first()[0]
    slices = max(1, -(-words * numbered.count() // rows))
    parts = [written(_by_words(numbered, edges, F.pmod("word", F.lit(slices)) == i)) for i in range(slices)]
    return reduce(DataFrame.unionByName, parts).groupBy(G, "node").agg(
        F.sum("new").alias("reached"), F.sum(F.col("new") * F.col("dist")).alias("total"),
        F.max(F.when(F.col("new") > 0, F.col("dist"))).cast("long").alias("longest"))


def levels_from(sources: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Breadth-first levels from the sources: (graph_id, s, t, dist, sigma), one table per distance.

    sigma counts the shortest paths from s to t.
    """
    steps = edges.where(~F.col("src").eqNullSafe(F.col("dst")))
    levels = [sources.select(G, F.col("node").alias("s"), F.col("node").alias("t"), F.lit(0).alias("dist"),
                             F.lit(1.0).alias("sigma"))]
    seen = levels[0].select(G, "s", "t")
    while True:
        last = levels[-1].withColumnRenamed("t", "src")
        reached = matched(last, steps, [G, "src"]).groupBy(G, "s", F.col("dst").alias("t")).agg(
            (F.first("dist") + 1).alias("dist"), F.sum("sigma").alias("sigma"))
        level = written(matched(reached, seen, [G, "s", "t"], "left_anti"))
        if level.isEmpty():
            return levels
        levels.append(level)
        seen = seen.unionByName(level.select(G, "s", "t"))


def _dependencies(nodes: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """(graph_id, node, raw): dependencies of all sources on each node, a slice of sources after the other."""
    steps = edges.where(~F.col("src").eqNullSafe(F.col("dst")))
    n = nodes.count()
    slices = max(1, -(-n * n // rows))
    parts: list[DataFrame] = []
    for i in range(slices):
        below: DataFrame | None = None
        for level in reversed(levels_from(nodes.where(F.pmod(F.xxhash64(G, "node"), F.lit(slices)) == i), edges)):
            here = level.withColumn("delta", F.lit(0.0))
            if below is not None:
                back = matched(below.withColumnRenamed("t", "dst"), steps, [G, "dst"]).select(
                    G, "s", F.col("src").alias("t"), "share")
                handed = matched(level.select(G, "s", "t", "sigma"), back, [G, "s", "t"]).groupBy(G, "s", "t").agg(
                    (F.first("sigma") * F.sum("share")).alias("delta"))
                here = written(matched(level, handed, [G, "s", "t"], "left").withColumn(
                    "delta", F.coalesce("delta", F.lit(0.0))))
            parts.append(here.where(~F.col("s").eqNullSafe(F.col("t")) & (F.col("delta") > 0)).select(
                G, F.col("t").alias("node"), "delta"))
            below = here.select(G, "s", "t", ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
    return reduce(DataFrame.unionByName, parts).groupBy(G, "node").agg(F.sum("delta").alias("raw"))


def _on_the_cluster(nodes: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    steps = edges.where(~F.col("src").eqNullSafe(F.col("dst"))).select(G, "src", "dst").distinct()
    both = steps.unionByName(steps.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    two = _distance_sums(nodes, both, rows).select(
        G, "node", F.col("reached").alias("pairs"), F.col("total").alias("length"), "longest")
    one = _distance_sums(nodes, steps, rows).select(G, "node", "reached", "total")
    joined = reduce(lambda a, b: matched(a, b, [G, "node"], "left"), [one, _dependencies(nodes, steps, rows), two], nodes)
    return joined.select(G, "node", *[F.coalesce(c, F.lit(0)).cast("double" if c == "raw" else "long").alias(c) for c in SUMS])


def distance_sums(nodes: DataFrame, edges: DataFrame, work: int = WORK, rows: int = ROWS) -> DataFrame:
    """One row per node (graph_id, node as strings):

    reached, total: other nodes that reach it along edges, and the sum of their distances;
    raw: its dependencies, the sum over pairs of other nodes of the share of shortest paths that pass it;
    pairs, length, longest: other nodes it is connected with, edges taken both ways, the sum of distances and the largest.

    Null graphs and nodes are ids like others; loops do not count; every end of an edge must be among the nodes.
    """
    nodes, edges = nodes.select(F.col(G).cast("string"), "node"), edges.select(F.col(G).cast("string"), "src", "dst")
    n = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy(G).agg(F.count(F.lit(1)).alias("m"))
    large = written(matched(n, m, [G], "left").where(F.col("n").cast("double") * F.coalesce("m", F.lit(0)) > work).select(G))
    if large.isEmpty():
        return _in_tasks(nodes, edges)
    small = _in_tasks(matched(nodes, large, [G], "left_anti"), matched(edges, large, [G], "left_anti"))
    return small.unionByName(_on_the_cluster(
        written(matched(nodes, large, [G], "left_semi")), written(matched(edges, large, [G], "left_semi")), rows))
