"""Metrics of many graphs at once over an edge table keyed by `graph_id`; a null graph or node is one like any other.

Components come from union-find inside tasks and contraction between them, distances and betweenness from searches that
return sums per node (`distances`), triangles from degree-ordered edges, so that a hub does not pair up all of its
neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.operators.components import connected
from diffscope.operators.distances import G, distance_sums, levels_from, matched
from diffscope.session import written



def distinct_edges(edges: DataFrame, graph_id: str = G) -> DataFrame:
    return edges.select(F.col(graph_id).alias(G), F.col("src").cast("string"), F.col("dst").cast("string")).distinct()


def edge_nodes(edges: DataFrame) -> DataFrame:
    """Distinct nodes that occur in an edge."""
    return edges.select(G, F.explode(F.array("src", "dst")).alias("node")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without self-loops."""
    forward = edges.where("NOT (src <=> dst)").select(G, F.explode(F.array(
        F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    return forward.select(G, "e.src", "e.dst").distinct()


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(G).agg(F.count(F.lit(1)).alias("num_nodes"))


# ---------------------------------------------------------------- components

def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): smallest node of each weakly connected component."""
    def end(name: str) -> Column:
        return F.struct(F.col(G), F.col(name).isNull().alias("none"), F.col(name).alias("node"))  # null is the last node

    linked = edges.where(~F.col("src").eqNullSafe(F.col("dst")))
    roots = connected(linked.select(end("src").alias("u"), end("dst").alias("v")), written).select(
        f"node.{G}", "node.node", F.col("root.node").alias("component"))
    return matched(nodes, roots, [G, "node"], "left").select(G, "node", F.coalesce("component", "node").alias("component"))


# ---------------------------------------------------------------- distances

def shortest_paths(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(graph_id, s, t, dist, sigma) for every reachable ordered pair, s itself at distance 0: for those who want the pairs."""
    return reduce(DataFrame.unionByName, levels_from(nodes, edges if directed else undirected(edges)))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, degree_centrality): in plus out degree over n-1; 1 for a single node."""
    ends = edges.select(G, F.explode(F.array("src", "dst")).alias("node")).groupBy(G, "node").agg(
        F.count(F.lit(1)).alias("d"))
    sized = matched(matched(nodes, _sizes(nodes), [G]), ends, [G, "node"], "left")
    return sized.select(G, "node", F.when(F.col("num_nodes") <= 1, F.lit(1.0)).otherwise(
        F.coalesce("d", F.lit(0)) / (F.col("num_nodes") - 1)).alias("degree_centrality"))


def closeness(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """(graph_id, node, closeness) from `distance_sums`: incoming distances, scaled by the reachable share."""
    sized = matched(matched(nodes, _sizes(nodes), [G]), sums.select(G, "node", "reached", "total"), [G, "node"], "left")
    value = F.col("reached") / F.col("total") * F.col("reached") / (F.col("num_nodes") - 1)
    return sized.select(G, "node", F.when((F.col("total") > 0) & (F.col("num_nodes") > 1), value)
                        .otherwise(F.lit(0.0)).alias("closeness"))


def betweenness(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """(graph_id, node, betweenness) from `distance_sums`: directed, unweighted, over (n-1)(n-2)."""
    n = F.col("num_nodes").cast("double")
    value = F.coalesce("raw", F.lit(0.0)) * F.when(n > 2, 1 / ((n - 1) * (n - 2))).otherwise(F.lit(1.0))
    sized = matched(matched(nodes, _sizes(nodes), [G]), sums.select(G, "node", "raw"), [G, "node"], "left")
    return sized.select(G, "node", value.alias("betweenness"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, clustering): undirected clustering coefficient.

    Edges point from the end of lower degree to the higher one, which bounds the neighbours that are paired at any node
    by the square root of the edge count, hubs included.
    """
    both = undirected(edges)
    deg = both.groupBy(G, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    ranked = matched(matched(both.where("least(src, dst) <=> src OR src IS NULL"), deg.select(
        G, F.col("node").alias("src"), F.col("d").alias("ds")), [G, "src"]), deg.select(
        G, F.col("node").alias("dst"), F.col("d").alias("dd")), [G, "dst"])
    swap = F.struct("ds", "src") > F.struct("dd", "dst")
    out = ranked.select(G, F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("a"),
                        F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()
    wedges = matched(out, out.withColumnRenamed("b", "c"), [G, "a"]).where(F.struct("b") < F.struct("c"))
    closed = matched(wedges, both.select(G, F.col("src").alias("b"), F.col("dst").alias("c")), [G, "b", "c"])
    triangles = (closed.select(G, F.explode(F.array("a", "b", "c")).alias("node"))
                 .groupBy(G, "node").agg(F.count(F.lit(1)).alias("t")))
    value = F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1)))
    return matched(matched(nodes, deg, [G, "node"], "left"), triangles, [G, "node"], "left").select(
        G, "node", F.coalesce(value, F.lit(0.0)).alias("clustering"))


# ---------------------------------------------------------------- one row per graph

def basic_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, num_nodes, num_edges, density, is_connected)."""
    groups = components(nodes, edges).groupBy(G).agg(
        F.count(F.lit(1)).alias("num_nodes"),
        F.sum(F.col("node").eqNullSafe(F.col("component")).cast("long")).alias("parts"))
    counted = edges.groupBy(G).agg(F.count(F.lit(1)).alias("num_edges"))
    n, m = F.col("num_nodes"), F.coalesce("num_edges", F.lit(0))
    return matched(groups, counted, [G], "left").select(
        G, "num_nodes", m.cast("long").alias("num_edges"),
        F.when(n > 1, m / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"),
        (F.col("parts") == 1).alias("is_connected"))


def path_metrics(basic: DataFrame, sums: DataFrame) -> DataFrame:
    """(graph_id, avg_path_length, diameter) from `distance_sums`, edges taken both ways; 0 where the graph is not connected."""
    lengths = sums.groupBy(G).agg((F.sum("length") / F.nullif(F.sum("pairs"), F.lit(0))).alias("mean"),
                                  F.max("longest").alias("far"))
    joined = matched(basic, lengths, [G], "left")
    linked = F.col("is_connected") & F.col("mean").isNotNull()
    return joined.select(G, F.when(linked, F.col("mean")).otherwise(F.lit(0.0)).alias("avg_path_length"),
                         F.when(linked, F.col("far")).otherwise(F.lit(0)).alias("diameter"))


def summarize(values: DataFrame, column: str, name: str) -> DataFrame:
    """avg_<name> and max_<name> per graph."""
    return values.groupBy(G).agg(F.avg(column).alias(f"avg_{name}"), F.max(column).alias(f"max_{name}"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, graph_id: str = G, graphs: DataFrame | None = None) -> DataFrame:
    """All graph metrics, one row per graph with structs basic_metrics, centrality_measures, structural_metrics.

    Node tables must be distinct per graph. `graphs`, if given, lists the graph ids to report, so that graphs without
    nodes get a row of zeros.
    """
    nodes = written(nodes.select(F.col(graph_id).cast("string").alias(G), F.col("node").cast("string")))
    edges = written(distinct_edges(edges, graph_id).withColumn(G, F.col(G).cast("string")))
    sums = written(distance_sums(nodes, edges))
    basic = written(basic_metrics(nodes, edges))
    parts = [summarize(degree(nodes, edges), "degree_centrality", "degree_centrality"),
             summarize(betweenness(nodes, sums), "betweenness", "betweenness_centrality"),
             summarize(closeness(nodes, sums), "closeness", "closeness_centrality"),
             summarize(clustering(nodes, edges), "clustering", "clustering_coefficient"), path_metrics(basic, sums)]
    joined = reduce(lambda a, b: matched(a, b, [G], "left"), parts, basic)
    if graphs is not None:
        joined = matched(graphs.select(F.col(graph_id).cast("string").alias(G)), joined, [G], "left")

    def group(*names: str) -> Column:
        def default(name):
            return F.lit(False) if name == "is_connected" else F.lit(0)

        return F.struct(*[F.coalesce(F.col(n), default(n)).alias(n) for n in names])

    return joined.select(
        F.col(G).alias(graph_id),
        group("num_nodes", "num_edges", "density", "is_connected").alias("basic_metrics"),
        group(*[f"{a}_{m}_centrality" for m in ("degree", "betweenness", "closeness") for a in ("avg", "max")])
        .alias("centrality_measures"),
        group("avg_clustering_coefficient", "max_clustering_coefficient", "avg_path_length", "diameter")
        .alias("structural_metrics"))
