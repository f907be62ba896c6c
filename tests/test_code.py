"""Syntax, code-graph and label values of fixed snippets."""

import ast

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffscope.functions import syntax
from diffscope.functions.syntax import parse_snippet, register, walk_nodes
from diffscope.operators.code_graph import code_graph_features, definition_graph
from diffscope.operators.features import labelled_features, with_code, with_parses
from diffscope.operators.labels import quality_labels
from diffscope.operators.syntax_metrics import nesting_depth, raw_metrics, tree_metrics, with_nodes

SNIPPETS = {
    "S1": "for i in range(3):\n    pass",
    "S2": "def fact(n):\n    if n <= 1:\n        return 1\n    return n * fact(n - 1)",
    "S3": "def f(a, b):\n    try:\n        if a:\n            x = g(h(a))\n        elif b:\n            x = 2\n        else:\n"
          "            x = 3\n    except ValueError:\n        raise\n    return x",
    "S4": "import os\n\ndef one(p):\n    q = p + 1\n    return q\n\ndef two(p):\n    r = one(p)\n    print(r)\n    return r\n"
          "z = two(4)",
    "S5": "class A:\n    def m(self):\n        def inner(v):\n            w = v\n            return w\n        while True:\n"
          "            for k in [1]:\n                with open('f') as fh:\n                    inner(k)\n        else:\n"
          "            if k:\n                pass",
    "S6": "# note\n    x = 1\n    y = x",
    "S7": "def (:\n  ===",
    "S8": "print(1)  # TODO\nwhile x:\n    if x:\n        print(22)\nfrom m import *",
}
TREE = {
    "ast_depth": [4, 7, 8, 5, 9, 4, 0, 6], "total_nodes": [9, 25, 38, 44, 42, 12, 0, 19],
    "num_functions": [0, 1, 1, 2, 2, 1, 0, 0], "num_classes": [0, 0, 0, 0, 1, 0, 0, 0],
    "num_imports": [0, 0, 0, 1, 0, 0, 0, 1], "num_loops": [1, 0, 0, 0, 2, 0, 0, 1],
    "num_conditionals": [0, 1, 2, 0, 1, 0, 0, 1], "num_try_blocks": [0, 0, 1, 0, 0, 0, 0, 0],
    "cyclomatic_complexity": [2, 2, 5, 1, 5, 1, 0, 3], "cognitive_complexity": [1, 1, 6, 0, 8, 0, 0, 3],
    "function_calls": [1, 1, 2, 3, 2, 0, 0, 2], "assignments": [0, 0, 3, 3, 1, 2, 0, 0],
    "returns": [0, 2, 1, 2, 1, 0, 0, 0], "exceptions": [0, 0, 1, 0, 0, 0, 0, 0],
}
GRAPH = {
    "cfg_nodes": [1, 2, 3, 2, 4, 1, 0, 2], "cfg_edges": [0, 1, 2, 0, 2, 0, 0, 1],
    "cfg_connected_components": [1, 1, 1, 2, 2, 1, 0, 1], "dep_nodes": [2, 2, 7, 7, 7, 3, 0, 2],
    "dep_edges": [0, 2, 9, 12, 9, 3, 0, 0], "function_connectivity": [0, 1, 0, 1, 0, 0, 0, 0],
    "variable_scope_complexity": [0, 1, 3, 4, 5, 2, 0, 0], "call_chain_depth": [1, 1, 2, 1, 1, 0, 0, 1],
}
SCORES = [0.5, 0.65, 0.6, 0.5499999999999999, 0.6000000000000001, 0.6, 0.6, 0.0]
ISSUES = [[], [], ["no_comments"], ["debug_prints_detected"],
          ["no_comments", "while_loop_detected", "inconsistent_indentation"], [], [],
          ["while_loop_detected", "todo_markers_detected", "debug_prints_detected", "wildcard_import_detected"]]


def hunks(spark, codes):
    rows = [(k, v.split("\n"), [], []) for k, v in codes.items()]
    return spark.createDataFrame(rows, "k string, added_lines array<string>, removed_lines array<string>, "
                                       "context_lines array<string>")


@pytest.fixture(scope="module")
def parsed(spark):
    return with_parses(with_code(hunks(spark, SNIPPETS))).persist()


def values(df, columns):
    rows = {r["k"]: r for r in df.select("k", *[c.alias(n) for n, c in columns.items()]).collect()}
    return {n: [rows[k][n] for k in SNIPPETS] for n in columns}


def test_tree_metrics(parsed):
    got = values(parsed, tree_metrics(F.col("nodes")))
    assert {n: got[n] for n in TREE} == TREE
    assert got["unique_variables"] == [0, 0, 1, 3, 1, 2, 0, 0]


def test_graph_metrics(parsed):
    got = values(parsed, code_graph_features(F.col("nodes")))
    assert {n: got[n] for n in GRAPH} == GRAPH


def test_labels(parsed):
    rows = {r["k"]: r for r in quality_labels(parsed).collect()}
    assert [rows[k]["quality_score"] for k in SNIPPETS] == SCORES
    assert [rows[k]["issues"] for k in SNIPPETS] == ISSUES
    assert values(parsed, {"d": nesting_depth(F.col("label_nodes"))})["d"] == [1, 1, 3, 0, 3, 0, 0, 2]


def test_threshold_is_sharp(spark):
    # 0.5 - 0.05 must not be good
    row = quality_labels(with_parses(with_code(hunks(spark, {"a": "while x:\n    x = x - 1"})))).first()
    assert row["quality_score"] == pytest.approx(0.45) and row["is_high_quality"] is False


def test_both_modes_when_they_differ(spark):
    code = "x = 1\n\n    # deep\n\ny = 2"
    rows = with_parses(with_code(hunks(spark, {"a": code, "b": "x = '''\n\n'''\ny = 1"}))).select(
        "k", F.size("nodes").alias("n"), F.size("label_nodes").alias("m"), "label_status").collect()
    assert all(r["n"] > 0 and r["n"] == r["m"] and r["label_status"] == "ok" for r in rows)


def test_raw_metrics_are_null_when_unparseable(spark):
    df = with_nodes(spark.createDataFrame([("a", "class A:\n  def f(s):\n    def g(): pass"), ("b", "def (")],
                                          "k string, code string"), "code", "raw")
    rows = {r["k"]: r.asDict() for r in df.select("k", *[c.alias(n) for n, c in raw_metrics(F.col("nodes")).items()]).collect()}
    assert rows["a"] == {"k": "a", "num_functions": 2, "num_classes": 1, "num_imports": 0, "max_nesting_depth": 3}
    assert rows["b"]["num_functions"] is None


def test_definition_graph(spark):
    code = "def a():\n    pass\nclass K:\n    def m(self):\n        a()\n    x = 1\ndef b():\n    a()\n    later()\ndef later(): pass"
    nodes, edges = definition_graph(with_nodes(spark.createDataFrame([(1, code)], "k int, code string"), "code", "raw"), ["k"])
    assert {(r["node"], r["kind"]) for r in nodes.collect()} == {
        ("a", "function"), ("K", "class"), ("K.m", "method"), ("m", "function"), ("b", "function"), ("later", "function")}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("K", "K.m"), ("m", "a"), ("b", "a")}


def test_sql_function(spark):
    register(spark)
    n = spark.sql("SELECT size(parse_raw('x = 1').nodes) AS n, parse_label('def (').status AS s").first()
    assert (n["n"], n["s"]) == (5, "syntax")


def test_labelled_features_drop_blank_hunks(spark):
    rows = labelled_features(hunks(spark, {"a": "x = 1", "blank": "  \n", "comment": "# only"})).collect()
    assert [r["k"] for r in rows] == ["a"]
    f = rows[0]["features"]
    assert f["ast_name_count"] == 1 and f["lines_added"] == 1 and f["files_changed"] == 1 and f["has_no_comments"] == 0


names = st.sampled_from(["a", "b", "f", "g"])
lines = st.one_of(
    st.builds("{} = {}".format, names, names), st.builds("def {}({}): return {}({})".format, names, names, names, names),
    st.builds("for {} in {}: {}({})".format, names, names, names, names), st.builds("if {}: {} = 1".format, names, names))


@given(st.lists(lines, min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_walk_visits_every_node_once(body):
    tree = ast.parse("\n".join(body))
    rows = walk_nodes(tree)
    assert len(rows) == sum(1 for _ in ast.walk(tree))
    assert [r[0] for r in rows] == list(range(len(rows)))
    flow = [r for r in rows if r[15] is not None]
    assert all(r[15] < r[0] for r in flow)


@pytest.mark.parametrize("code", ["(" * 5000, "\x00", "x = " + "-" * 100000 + "1"])
def test_parser_never_fails(code):
    for mode in ("extractor", "label", "raw"):
        assert parse_snippet(code, mode)[0] in ("ok", "wrapped", "blank", "syntax", "limit")


def test_definition_graph_parses_once(spark):
    nodes, edges = definition_graph(with_nodes(spark.createDataFrame([(1, "def a():\n    pass")], "k int, code string"), "code", "raw"), ["k"])
    for table in (nodes, edges):
        assert "ArrowEvalPython" not in table._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_fields_of_many_nodes(spark, monkeypatch):
    codes = ["x = 1", "def f(:", "for i in a:\n    pass", "x = 1"] * 3
    monkeypatch.setattr(syntax, "CHUNK_ROWS", 4)
    few = syntax._batch_parser("raw", ("node_type", "ctl_depth"))(pa.array(codes)).to_pylist()
    monkeypatch.setattr(syntax, "CHUNK_ROWS", 10**6)
    whole = syntax._batch_parser("raw", syntax.FIELDS)(pa.array(codes)).to_pylist()
    assert [r["status"] for r in few] == [r["status"] for r in whole]
    assert [r["nodes"] for r in few] == [[{k: n[k] for k in ("node_type", "ctl_depth")} for n in r["nodes"]] for r in whole]
    assert set(few[0]["nodes"][0]) == {"node_type", "ctl_depth"} and len(whole[0]["nodes"][0]) == 17
