"""Syntax metrics as expressions over the node array of a snippet (no shuffle), and node tables exploded from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.functions.syntax import FIELDS, parse_nodes
from diffscope.functions.text import let, line_metrics

CONTROL = ("If", "For", "While", "Try", "With")


def with_nodes(df: DataFrame, code: str, mode: str = "extractor", column: str = "nodes",
               status: str | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Add the node array of `code`; empty when the code does not parse. `status` names an optional status column.

    `fields` are those the nodes have: what is not used need not be sent from the Python workers.
    """
    parsed = df.withColumn("_parsed", parse_nodes(F.col(code), mode, fields))
    out = parsed.withColumn(column, F.col("_parsed.nodes"))
    if status:
        out = out.withColumn(status, F.col("_parsed.status"))
    return out.drop("_parsed")


def ast_nodes(df: DataFrame, code: str, key: list[str], mode: str = "extractor") -> DataFrame:
    """Node table: one row per syntax node, keyed by `key`."""
    nodes = with_nodes(df.select(*key, code), code, mode)
    # outer: a plain explode would make the optimizer repeat the parse in a not-empty filter
    return (nodes.select(*key, F.lit(mode).alias("mode"), F.explode_outer("nodes").alias("n"))
            .where("n is not null").select(*key, "mode", "n.*"))


def _types(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["node_type"])


def _tally(types: Column, *names: str) -> Column:
    if len(names) == 1:
        return F.size(F.filter(types, lambda t: t == names[0]))
    return F.size(F.filter(types, lambda t: t.isin(*names)))


def _peak(nodes: Column, value) -> Column:
    return F.coalesce(F.array_max(F.transform(nodes, value)), F.lit(0))


def nesting_depth(nodes: Column) -> Column:
    """Deepest nesting of control statements, the innermost included."""
    control = F.filter(nodes, lambda n: n["node_type"].isin(*CONTROL))
    return _peak(control, lambda n: n["ctl_depth"] + 1)


def has_docstring(nodes: Column) -> Column:
    return F.exists(nodes, lambda n: n["is_docstr"])


def unique_node_types(nodes: Column) -> Column:
    return F.size(F.array_distinct(_types(nodes)))


def tree_metrics(nodes: Column, types: Column | None = None) -> dict[str, Column]:
    """Counts, depth and complexity of an `extractor` node array; all 0 when it is empty.

    `types`, if given, is a column with the node types, so that each metric need not take them from the nodes again.
    """
    types = _types(nodes) if types is None else types
    control = F.filter(nodes, lambda n: n["node_type"].isin(*CONTROL))
    parsed = F.size(nodes) > 0
    branch = _tally(types, "If", "For", "While", "Try", "With", "ExceptHandler")
    targets = F.filter(nodes, lambda n: (n["field"] == "targets") & (n["node_type"] == "Name") & (n["ctx"] == "Store"))
    return {
        "ast_depth": _peak(nodes, lambda n: n["depth"]),
        "total_nodes": F.size(nodes),
        "num_functions": _tally(types, "FunctionDef"),
        "num_classes": _tally(types, "ClassDef"),
        "num_imports": _tally(types, "Import", "ImportFrom"),
        "num_loops": _tally(types, "For", "While"),
        "num_conditionals": _tally(types, "If"),
        "num_try_blocks": _tally(types, "Try"),
        "cyclomatic_complexity": F.when(parsed, branch + 1).otherwise(0),
        "cognitive_complexity": F.aggregate(control, F.lit(0), lambda acc, n: acc + n["ctl_depth"] + 1),
        "function_calls": _tally(types, "Call"),
        "assignments": _tally(types, "Assign"),
        "returns": _tally(types, "Return"),
        "exceptions": _tally(types, "Raise"),
        "unique_variables": F.size(F.array_distinct(F.transform(targets, lambda n: n["name"]))),
    }


def function_names(nodes: Column) -> Column:
    """Names of the functions in source order."""
    return F.transform(F.filter(nodes, lambda n: n["node_type"] == "FunctionDef"), lambda n: n["name"])


def node_types(nodes: Column) -> Column:
    """The node types alone, in the order of the nodes."""
    return _types(nodes)


def node_count_map(nodes: Column, types: Column | None = None) -> Column:
    """MAP ast_<type>_count -> count for the node types present; `types` as in `tree_metrics`."""
    def entry(types: Column, t: Column) -> Column:
        return F.struct(F.concat(F.lit("ast_"), F.lower(t), F.lit("_count")),
                        F.size(F.filter(types, lambda x: x == t)).cast("double"))

    return let(_types(nodes) if types is None else types, lambda types: F.map_from_entries(
        F.transform(F.array_distinct(types), lambda t: entry(types, t))))


def raw_metrics(nodes: Column) -> dict[str, Column]:
    """Definition counts from a `raw` node array; null when the code does not parse."""
    types = _types(nodes)
    parsed = F.size(nodes) > 0
    defs = F.filter(nodes, lambda n: n["node_type"].isin("FunctionDef", "ClassDef"))
    values = {
        "num_functions": _tally(types, "FunctionDef"),
        "num_classes": _tally(types, "ClassDef"),
        "num_imports": _tally(types, "Import", "ImportFrom"),
        "max_nesting_depth": _peak(defs, lambda n: n["def_depth"]),
    }
    return {name: F.when(parsed, value) for name, value in values.items()}


def label_metrics(nodes: Column) -> dict[str, Column]:
    """Features taken from a `label` node array."""
    return {
        "nesting_depth": nesting_depth(nodes),
        "ast_parseable": (F.size(nodes) > 0).cast("int"),
        "unique_ast_nodes": unique_node_types(nodes),
        "total_ast_nodes": F.size(nodes),
    }


def ast_node_counts(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Count per node type over a node table (partial aggregation keeps the shuffle to one row per type)."""
    return nodes.groupBy(*key, "node_type").agg(F.count(F.lit(1)).alias("n"))


def ast_metrics(df: DataFrame, code: str, key: list[str]) -> DataFrame:
    """Snippet table to one row of syntax metrics per snippet."""
    return with_nodes(df.select(*key, code), code).select(
        *key, *[c.alias(n) for n, c in tree_metrics(F.col("nodes")).items()])


def code_metrics(df: DataFrame, code: str, key: list[str]) -> DataFrame:
    """Line metrics plus definition counts of the code as given."""
    parsed = with_nodes(df.select(*key, code), code, "raw")
    lines = F.split(F.col(code), "\n")
    return parsed.select(*key, *[c.alias(n) for n, c in {**line_metrics(lines),
                                                         **raw_metrics(F.col("nodes"))}.items()])
