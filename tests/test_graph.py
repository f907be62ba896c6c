"""Graph metrics of fixed graphs."""

import random

import pytest
from pyspark.sql import functions as F

from diffscope.operators import distances

from diffscope.operators import graph as G

EDGES = {"g1": "ab bc cd ac dd", "g2": "ab cd", "g3": "ab bc ca cd de", "loop": "aa"}
EXPECT = {  # n, m, density, connected, then avg/max degree, betweenness, closeness, clustering, avg path, diameter
    "g1": (4, 5, 0.416667, True, 0.833333, 1.0, 0.083333, 0.333333, 0.4, 0.666667, 0.583333, 1.0, 1.333333, 2),
    "g2": (4, 2, 0.166667, False, 0.333333, 0.333333, 0, 0, 0.166667, 0.333333, 0, 0, 0, 0),
    "g3": (5, 5, 0.25, True, 0.5, 0.75, 0.2, 0.416667, 0.355, 0.4, 0.466667, 1.0, 1.7, 3),
    "loop": (1, 1, 0, True, 1.0, 1.0, 0, 0, 0, 0, 0, 0, 0, 0),
    "empty": (0, 0, 0, False, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
}


def table(spark, graphs):
    return spark.createDataFrame([(g, e[0], e[1]) for g, es in graphs.items() for e in es.split()],
                                 "graph_id string, src string, dst string")


def test_graph_metrics(spark):
    edges = table(spark, EDGES)
    graphs = spark.createDataFrame([(g,) for g in EXPECT], "graph_id string")
    rows = G.graph_metrics(G.edge_nodes(edges), edges, graphs=graphs).collect()
    got = {r.graph_id: (*r.basic_metrics, *r.centrality_measures, *r.structural_metrics) for r in rows}
    for g, values in EXPECT.items():
        assert got[g] == pytest.approx(values, abs=1e-6), g


def test_long_chain_is_one_component(spark):
    names = [f"n{i:03d}" for i in range(120)]
    edges = spark.createDataFrame([("g", a, b) for a, b in zip(names, names[1:]) if a != "n059"],
                                  "graph_id string, src string, dst string")
    rows = G.components(G.edge_nodes(edges), edges).collect()
    assert {r.component for r in rows} == {"n000", "n060"} and len(rows) == 120


def test_isolated_nodes_count(spark):
    edges = table(spark, {"g": "ab"})
    nodes = spark.createDataFrame([("g", n) for n in "abc"], "graph_id string, node string")
    row = G.basic_metrics(nodes, edges).first()
    assert (row.num_nodes, row.num_edges, row.is_connected) == (3, 1, False)


def brute(nodes, edges):
    """Sums of each node of one graph, by searches in plain Python."""
    def search(start, step):
        distance, paths, order = {start: 0}, {start: 1.0}, [start]
        for x in order:
            for y in step.get(x, ()):
                if y not in distance:
                    distance[y], paths[y] = distance[x] + 1, 0.0
                    order.append(y)
                if distance[y] == distance[x] + 1:
                    paths[y] += paths[x]
        return distance, paths, order

    one, two = {}, {}
    for a, b in {(a, b) for a, b in edges if a != b}:
        one.setdefault(a, set()).add(b)
        two.setdefault(a, set()).add(b)
        two.setdefault(b, set()).add(a)
    out = {x: [0, 0, 0.0, 0, 0, 0] for x in nodes}
    for s in nodes:
        distance, paths, order = search(s, one)
        share = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            for y in one.get(x, ()):
                if distance[y] == distance[x] + 1:
                    share[x] += paths[x] / paths[y] * (1 + share[y])
            if x != s:
                out[x][0] += 1
                out[x][1] += distance[x]
                out[x][2] += share[x]
        far = [d for d in search(s, two)[0].values() if d]
        out[s][3:] = [len(far), sum(far), max(far, default=0)]
    return out


def random_graphs():
    rng = random.Random(12)
    graphs = {}
    for g in [None, *"pqrstuvw"]:
        names = [None if i == 3 else f"n{i}" for i in range(rng.randint(1, 14))]
        graphs[g] = names, [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 30))]
    return graphs


@pytest.mark.parametrize("work, rows, cells", [(10**9, 10**6, 1 << 21), (10**9, 10**6, 40), (60, 10**6, 1 << 21), (0, 40, 1 << 21)])
def test_distance_sums(spark, monkeypatch, work, rows, cells):
    graphs = random_graphs() if work else dict(list(random_graphs().items())[:3])
    if cells < 100:  # worker code reads the module, so bind the bound through the closure of this process only
        ours = [(g, set(n), e) for g, (n, e) in graphs.items()]
        monkeypatch.setattr(distances, "CELLS", cells)
        found = [tuple(r.values()) for r in distances._searched(ours).to_pylist()]
    else:
        nodes = spark.createDataFrame([(g, n) for g, (names, _) in graphs.items() for n in names], "graph_id string, node string")
        edges = spark.createDataFrame([(g, *e) for g, (_, es) in graphs.items() for e in es],
                                      "graph_id string, src string, dst string")
        found = [tuple(r) for r in distances.distance_sums(nodes, edges, work, rows).collect()]
    got = {r[:2]: r[2:] for r in found}
    assert len(got) == len(found) == sum(len(n) for n, _ in graphs.values())
    for g, (names, es) in graphs.items():
        for x, values in brute(names, es).items():
            assert got[g, x] == pytest.approx(tuple(values), abs=1e-9), (g, x)


def test_chain_of_a_thousand_nodes(spark):
    names = [f"n{i:04d}" for i in range(1000)]
    edges = spark.createDataFrame([("g", a, b) for a, b in zip(names, names[1:])], "graph_id string, src string, dst string")
    sums = G.distance_sums(G.edge_nodes(edges), edges)
    rows = {r.node: r for r in sums.collect()}
    assert [rows[n].total for n in names[:4]] == [0, 1, 3, 6] and rows["n0500"].raw == 500 * 499
    assert rows["n0000"].longest == 999 and rows["n0000"].pairs == 999
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "sigma" not in plan


def test_null_graphs_and_nodes_count(spark):
    rows = [(None, "a", "b"), (None, "b", None), ("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a")]
    edges = spark.createDataFrame(rows, "graph_id string, src string, dst string")
    nodes = G.edge_nodes(edges)
    assert G.degree(nodes, edges).count() == G.components(nodes, edges).count() == G.clustering(nodes, edges).count() == 6
    assert {(r.graph_id, r.component) for r in G.components(nodes, edges).collect()} == {(None, "a"), ("g", "a")}
    found = {r.graph_id: r for r in G.graph_metrics(nodes, edges).collect()}
    assert found[None].basic_metrics.num_edges == 2 and found[None].basic_metrics.is_connected
    assert found[None].structural_metrics.diameter == 2 and found["g"].structural_metrics.avg_clustering_coefficient == 1
    assert {r.degree_centrality for r in G.degree(nodes, edges).where("graph_id IS NULL").collect()} == {0.5, 1.0}


def test_long_chain_settles_in_one_union_find(spark):
    n = 100_000
    edges = spark.range(n).select(F.lit("g").alias("graph_id"), F.format_string("n%06d", "id").alias("src"),
                                  F.format_string("n%06d", F.col("id") + 1).alias("dst"))
    found = G.components(G.edge_nodes(edges), edges)
    assert found.where("component = 'n000000'").count() == n + 1


def test_slices_are_bounded_by_steps_along_edges(monkeypatch):
    steps, run = [], distances.Search.run

    def noted(self, low, high, dependencies):
        steps.append((high - low) * len(self.target))
        return run(self, low, high, dependencies)

    monkeypatch.setattr(distances.Search, "run", noted)
    names = [f"{i:03d}" for i in range(200)]
    found = distances._searched([("g", set(names), [(a, b) for a in names for b in names])]).to_pydict()
    assert found["total"] == found["pairs"] == [199] * 200 and found["longest"] == [1] * 200
    assert max(steps) <= 1 << 18
