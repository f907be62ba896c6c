"""Graphs of a snippet: control flow, name dependencies and definitions, from its node array.

Edges are built as text pairs so that duplicates are removed by hashing; the pairs never leave the snippet's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.session import written

ARROW = "->"


def _pairs(items: Column, src, dst) -> Column:
    return F.transform(items, lambda n: F.concat(src(n), F.lit(ARROW), dst(n)))


def _density(n: Column, m: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 1, m / (n * (n - 1))).otherwise(F.lit(0.0))


def flow_nodes(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["cfg_parent"].isNotNull())


def flow_links(nodes: Column) -> Column:
    """Control statements that hang below another control-flow node; functions never do."""
    return F.filter(nodes, lambda n: (n["cfg_parent"] >= 0) & (n["node_type"] != "FunctionDef"))


def dependency_names(nodes: Column) -> Column:
    """Distinct names in the dependency graph."""
    used = F.filter(nodes, lambda n: (n["node_type"] == "FunctionDef") |
                    ((n["node_type"] == "Name") & n["ctx"].isin("Store", "Load")))
    return F.array_distinct(F.transform(used, lambda n: n["name"]))


def dependency_pairs(nodes: Column) -> Column:
    """Distinct edges: function->stored name, loaded name->function, function->called name."""
    inside = F.filter(nodes, lambda n: n["last_fn"].isNotNull() & n["name"].isNotNull() &
                      n["node_type"].isin("Name", "Call"))
    stores = F.filter(inside, lambda n: (n["node_type"] == "Name") & (n["ctx"] == "Store"))
    loads = F.filter(inside, lambda n: (n["node_type"] == "Name") & (n["ctx"] == "Load"))
    calls = F.filter(inside, lambda n: (n["node_type"] == "Call") & (n["name"] != n["last_fn"]))
    fn, name = (lambda n: n["last_fn"]), (lambda n: n["name"])
    return F.array_distinct(F.concat(_pairs(stores, fn, name), _pairs(loads, name, fn), _pairs(calls, fn, name)))


def call_pairs(nodes: Column) -> Column:
    """Distinct caller->callee pairs where the callee was defined at an earlier position."""
    calls = F.filter(nodes, lambda n: (n["node_type"] == "Call") & n["known"] & n["open_fn"].isNotNull())
    return F.array_distinct(_pairs(calls, lambda n: n["open_fn"], lambda n: n["name"]))


def scope_complexity(nodes: Column) -> Column:
    """Distinct local names, summed over the function scopes."""
    local = F.filter(nodes, lambda n: n["scope_fn"] >= 0)
    return F.size(F.array_distinct(_pairs(local, lambda n: n["scope_fn"].cast("string"), lambda n: n["name"])))


def call_chain_depth(nodes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(nodes, lambda n: n["call_depth"])), F.lit(0))


def code_graph_features(nodes: Column) -> dict[str, Column]:
    """Control-flow and dependency features of an `extractor` node array; all 0 when it is empty.

    The control-flow graph is a forest, so its components are nodes minus edges.
    """
    cfg_n, cfg_m = F.size(flow_nodes(nodes)), F.size(flow_links(nodes))
    dep_n, dep_m = F.size(dependency_names(nodes)), F.size(dependency_pairs(nodes))
    return {
        "cfg_nodes": cfg_n,
        "cfg_edges": cfg_m,
        "cfg_density": _density(cfg_n, cfg_m),
        "cfg_connected_components": cfg_n - cfg_m,
        "dep_nodes": dep_n,
        "dep_edges": dep_m,
        "dep_density": _density(dep_n, dep_m),
        "function_connectivity": F.size(call_pairs(nodes)),
        "variable_scope_complexity": scope_complexity(nodes),
        "call_chain_depth": call_chain_depth(nodes),
    }


def _edge_table(df: DataFrame, key: list[str], pairs: Column, kind: str) -> DataFrame:
    # outer: a plain explode would make the optimizer repeat the parse in a not-empty filter
    return (df.select(*key, F.explode_outer(pairs).alias("p")).where("p is not null")
            .select(*key, F.substring_index("p", ARROW, 1).alias("src"), F.substring_index("p", ARROW, -1).alias("dst"),
                    F.lit(kind).alias("kind")))


def cfg_edges(df: DataFrame, key: list[str], nodes: str = "nodes") -> DataFrame:
    """Control-flow edge table; ends are node ids of the snippet's tree."""
    pairs = _pairs(flow_links(F.col(nodes)), lambda n: n["cfg_parent"].cast("string"),
                   lambda n: n["node_id"].cast("string"))
    return _edge_table(df, key, pairs, "flow")


def dep_edges(df: DataFrame, key: list[str], nodes: str = "nodes") -> DataFrame:
    """Name-dependency edge table."""
    return _edge_table(df, key, dependency_pairs(F.col(nodes)), "depends")


def definition_graph(df: DataFrame, key: list[str], nodes: str = "nodes") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of functions, classes and methods from `raw` node arrays.

    A method appears both as Class.method and, as any function, under its bare name. The definitions and calls are written
    first: three tables come from them, and each would parse the code again.
    """
    n = F.filter(nodes, lambda x: x["node_type"].isin("FunctionDef", "ClassDef", "Call"))
    df = written(df.select(*key, F.transform(n, lambda x: F.struct(*[
        x[f].alias(f) for f in ("node_type", "name", "open_fn", "known", "owner")])).alias(nodes)))
    n = F.col(nodes)
    functions = F.filter(n, lambda x: x["node_type"] == "FunctionDef")
    classes = F.filter(n, lambda x: x["node_type"] == "ClassDef")
    methods = F.filter(functions, lambda x: x["owner"].isNotNull())

    def full_name(x):
        return F.concat(x["owner"], F.lit("."), x["name"])

    named = F.array_distinct(F.concat(
        F.transform(functions, lambda x: F.struct(x["name"].alias("node"))),
        F.transform(classes, lambda x: F.struct(x["name"].alias("node"))),
        F.transform(methods, lambda x: F.struct(full_name(x).alias("node"))))["node"])
    method_names = F.array_distinct(F.transform(methods, full_name))
    class_names = F.array_distinct(F.transform(classes, lambda x: x["name"]))
    node_table = (df.select(*key, F.explode_outer(named).alias("node"), method_names.alias("_m"), class_names.alias("_c"))
                  .where("node is not null").select(*key, "node",
                          F.when(F.array_contains("_m", F.col("node")), "method")
                          .when(F.array_contains("_c", F.col("node")), "class").otherwise("function").alias("kind")))
    owns = _edge_table(df, key, F.array_distinct(_pairs(methods, lambda x: x["owner"], full_name)), "owns")
    calls = _edge_table(df, key, call_pairs(n), "calls")
    return node_table, owns.unionByName(calls)
