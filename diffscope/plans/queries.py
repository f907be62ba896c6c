"""Registered queries: each runs one operator group over whole tables. Names match the statements in `oracle`."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffscope.functions import review_text as R
from diffscope.functions import text as X
from diffscope.operators import code_graph as CG
from diffscope.operators import diff as D
from diffscope.operators import evaluate as E
from diffscope.operators import explain as XP
from diffscope.operators import features as FE
from diffscope.operators import graph as G
from diffscope.operators import hooks as H
from diffscope.operators import labels as L
from diffscope.operators import models as M
from diffscope.operators import pooling as P
from diffscope.operators import review as RV
from diffscope.operators import sampling as S
from diffscope.operators import syntax_metrics as SM
from diffscope.operators import text_metrics as TM
from diffscope.operators import versions as VS
from diffscope.plans import derive as V
from diffscope.plans import pipeline as PL
from diffscope.plans.oracle import FEATURE_NAMES
from diffscope.session import checkpointed, configure, shared_folder, written
from diffscope.sources import patches as SP
from diffscope.sources import tables as ST
from diffscope.sources.log_dump import read_dump

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    REGISTRY[fn.__name__] = run
    return fn


def _docs(spark, folder) -> DataFrame:
    return V.table(spark, folder, "documents")


def _folder(spark) -> str:
    """A new path in the shared folder."""
    return posixpath.join(shared_folder(spark), "diffscope", uuid.uuid4().hex)


def _longs(columns: dict[str, Column]) -> list[Column]:
    return [c.cast("long").alias(n) for n, c in columns.items()]


def _doubles(columns: dict[str, Column]) -> list[Column]:
    return [F.round(c.cast("double"), 6).alias(n) for n, c in columns.items()]


def _lined(text: str) -> Column:
    return F.array_join(text, "\n")


# ------------------------------------------------------------------ patches

@query
def hunk_parse(spark, folder):
    hunks = D.patch_hunks(V.document_patches(_docs(spark, folder)))
    return hunks.select(
        "commit_hash", "file_path", "change_type", "hunk_type",
        *_longs({c: F.coalesce(F.col(c), F.lit(-1)) for c in (
            "hunk_idx", "old_start", "old_count", "new_start", "new_count", "line_start", "line_end", "files_changed",
            "total_hunks", "commit_size")}),
        F.md5(_lined("added_lines")).alias("added"), F.md5(_lined("removed_lines")).alias("removed"),
        F.md5(_lined("context_lines")).alias("context"))


@query
def hunk_parse_two_step(spark, folder):
    files = D.parse_files(V.document_patches(_docs(spark, folder)))
    hunks = D.with_commit_context(D.line_counts(D.parse_hunks(files)))
    return hunks.select("commit_hash", "file_path", *_longs({c: F.col(c) for c in (
        "hunk_idx", "n_added", "n_removed", "n_context", "files_changed", "total_hunks", "commit_size")}))


@query
def hunk_commit_join(spark, folder):
    """Hunks with the message, author and date of their commit."""
    docs = _docs(spark, folder)
    hunks = D.line_counts(D.patch_hunks(V.document_patches(docs))).select("commit_hash", "file_path", "hunk_idx", "n_added")
    commits = V.document_commits(docs)
    return hunks.join(commits, "commit_hash").select(
        "commit_hash", "file_path", *_longs({c: F.col(c) for c in ("hunk_idx", "n_added")}),
        F.md5("message").alias("message"), "author",
        F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))


@query
def file_change_types(spark, folder):
    files = D.parse_files(V.document_patches(_docs(spark, folder)))
    return files.groupBy("change_type", F.substring_index("file_path", ".", -1).alias("extension")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("is_binary").cast("long")).alias("binary_files"))


@query
def commit_stats(spark, folder):
    return D.patch_commit_stats(V.document_patches(_docs(spark, folder))).select("commit_hash", *_longs({
        c: F.col(c) for c in ("total_insertions", "total_deletions", "files_changed")}))


@query
def file_stats(spark, folder):
    return D.patch_file_stats(V.document_patches(_docs(spark, folder))).select("commit_hash", "file_path", "change_type",
                                      *_longs({c: F.col(c) for c in ("insertions", "deletions")}))


@query
def recent_commits(spark, folder):
    docs = _docs(spark, folder)
    commits = SP.with_parent(V.document_commits(docs))
    return SP.recent_commits(commits, limit=25)


@query
def commits_touching(spark, folder):
    """Commits with any Markdown file (semi join), newest first."""
    docs = _docs(spark, folder)
    files = D.parse_files(V.document_patches(docs)).where("file_path like '%.md'").select("commit_hash")
    touched = V.document_commits(docs).join(files, "commit_hash", "left_semi")
    return SP.recent_commits(touched, limit=40)


@query
def commit_sequence(spark, folder):
    return SP.with_sequence(V.document_commits(_docs(spark, folder))).select(
        "commit_hash", F.col("seq").cast("long").alias("seq"))


@query
def snapshot_diff(spark, folder):
    """Patches made from file contents, parsed back."""
    docs = _docs(spark, folder)
    path = F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    kind = F.when(F.col("doc_id") % 2 == 0, "A").otherwise("D")
    patches = docs.select("doc_id", D.snapshot_patch(path, kind, F.col("text")).alias("patch"))
    hunks = D.patch_hunks(patches)
    return hunks.select("doc_id", "change_type", *_longs({"old_count": F.col("old_count"),
                                                          "new_count": F.col("new_count")}),
                        F.md5(_lined("added_lines")).alias("added"), F.md5(_lined("removed_lines")).alias("removed"))


@query
def log_commits(spark, folder):
    """Commits of a log dump, newer ones only, without reading their patches into the JVM."""
    path = _folder(spark)
    V.document_log(_docs(spark, folder)).write.text(path)
    found = read_dump(spark, path, patch=False, split_bytes=1 << 20)
    return found.where(F.col("committed_at") >= F.timestamp_seconds(F.lit(1704067200 + 6000))).select(
        "commit_hash", "parent_hash", "is_merge", "author", F.md5("message").alias("message"), F.col("committed_date").alias("date"))


@query
def log_patches(spark, folder):
    """Statistics of every commit's patch, read from a log dump."""
    path = _folder(spark)
    V.document_log(_docs(spark, folder)).write.text(path)
    found = read_dump(spark, path)
    return D.patch_commit_stats(found.where(SP.has_patch()).select("commit_hash", "patch")).select("commit_hash", *_longs({
        c: F.col(c) for c in ("total_insertions", "total_deletions", "files_changed")}))


@query
def text_file_types(spark, folder):
    """Changed files without the binary ones."""
    files = D.parse_files(V.document_patches(_docs(spark, folder)), extensions=None, drop_binary=True)
    return files.groupBy("change_type", F.substring_index("file_path", ".", -1).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


@query
def staged_diffs(spark, folder):
    """Diff texts from a column of a table, as patches."""
    staged = V.document_patches(_docs(spark, folder)).select(F.substring("commit_hash", 1, 12).alias("change"), F.col("patch").alias("staged"))
    return D.patch_commit_stats(SP.patch_column(staged, "staged", "change")).select("commit_hash", *_longs({
        c: F.col(c) for c in ("total_insertions", "total_deletions", "files_changed")}))


@query
def comment_file(spark, folder):
    """Review comments written as CSV, texts with quotes and line ends included, and read with the declared schema."""
    path = _folder(spark)
    _docs(spark, folder).select(
        F.col("doc_id").cast("string").alias("commit_hash"), F.concat(F.lit("a,"), F.col("source")).alias("file_path"),
        (F.col("doc_id") % 100).cast("int").alias("line_number"), F.col("text").alias("comment"),
        (F.col("doc_id") % 8 / 8).alias("quality_score")).write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = ST.read_review_comments(spark, path)
    return found.select("commit_hash", "file_path", F.col("line_number").cast("long").alias("line_number"),
                        F.md5("comment").alias("comment"), "quality_score")


@query
def comment_sink(spark, folder):
    """Comments appended in two batches, one of them without commits."""
    path = _folder(spark)
    rows = _docs(spark, folder).select(F.col("source").alias("file_path"), F.length("text").alias("line_number"),
                                       F.col("text").alias("comment"), F.col("doc_id").cast("string").alias("commit_hash"))
    ST.append_comments(rows.where("line_number % 2 = 0"), path)
    ST.append_comments(rows.where("line_number % 2 = 1").drop("commit_hash"), path)
    return spark.read.parquet(path).select("file_path", F.col("line_number").cast("long").alias("line_number"),
                                           F.md5("comment").alias("comment"), "commit_hash")


@query
def result_sinks(spark, folder):
    """Metrics as JSON and an attention table as CSV, written and read back."""
    one, two = _folder(spark), _folder(spark)
    ST.write_results(E.class_distribution(V.table(spark, folder, "labels"), "quality"), one)
    ST.write_attention(_docs(spark, folder).select("doc_id", "source", (F.col("doc_id") % 16 / 16).alias("attention_weight")), two)
    results = spark.read.schema("label int, n long, total long, has_both boolean").json(one).select(
        F.lit("results").alias("sink"), F.col("label").cast("string").alias("key"), F.col("n").cast("double").alias("value"))
    attention = spark.read.csv(two, header=True, schema="doc_id long, source string, attention_weight double").select(
        F.lit("attention").alias("sink"), F.concat_ws(":", "doc_id", "source").alias("key"), F.col("attention_weight").alias("value"))
    return results.unionByName(attention)


@query
def full_file_hunks(spark, folder):
    docs = _docs(spark, folder).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"),
                                       F.col("text").alias("value"))
    return D.full_file_hunks(docs).select("file_path", "hunk_type", *_longs({
        "line_end": F.col("line_end"), "n_added": F.size("added_lines")}), F.md5(_lined("added_lines")).alias("added"))


@query
def version_diff(spark, folder):
    """Each reply of the assistant against its reply before, as a patch: what the patch makes of either of the two."""
    turns = V.table(spark, folder, "conversations").where("role = 'assistant'")
    versions = SP.previous_versions(turns.select(
        "conv_id", "turn", F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("seq"), F.col("text").alias("content")))
    path = F.concat(F.lit("chat/"), F.col("file_path"), F.lit(".md"))
    patched = versions.withColumn("patch", VS.version_patch(path, F.col("old_content"), F.col("content"))).withColumn(
        "change_type", VS.change_type(F.col("old_content"), F.col("content")))
    stats = D.patch_commit_stats(patched.select(F.struct("conv_id", "turn").alias("commit_hash"), "patch"))
    texts = patched.select("conv_id", "turn", "change_type",
                           F.sha2(VS.patched(F.col("old_content"), F.col("patch")), 256).alias("forward"),
                           F.sha2(VS.patched(F.col("content"), F.col("patch"), reverse=True), 256).alias("backward"))
    grown = (F.col("total_insertions") - F.col("total_deletions")).cast("long")
    return texts.join(stats.select("commit_hash.*", grown.alias("grown")), ["conv_id", "turn"])


@query
def file_asof(spark, folder):
    turns = V.table(spark, folder, "conversations")
    path = F.col("conv_id").cast("string").alias("file_path")
    snapshots = turns.where("role = 'assistant'").select(path, F.col("turn").alias("seq"), F.col("text").alias("content"))
    requests = turns.where("role <> 'assistant'").select(path, F.col("turn").alias("seq"))
    found = SP.files_as_of(snapshots, requests)
    return found.select("file_path", "seq", F.md5("content").alias("content"))


# ------------------------------------------------------------------ line metrics

@query
def line_metrics(spark, folder):
    doc = _docs(spark, folder)
    metrics = X.line_metrics(F.split("text", "\n"))
    average = metrics.pop("avg_line_length")
    return doc.select("doc_id", *_longs(metrics), *_doubles({"avg_line_length": average}))


@query
def regex_features(spark, folder):
    return _docs(spark, folder).select("doc_id", *_longs(X.regex_features(F.col("text"))))


@query
def code_regex_features(spark, folder):
    return V.document_code(_docs(spark, folder)).select("doc_id", *_longs(X.regex_features(F.col("code"))))


@query
def indent_features(spark, folder):
    indented = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.repeat(F.lit(" "), (i % 7).cast("int")), x))
    metrics = X.indent_features(X.indents(indented))
    average = metrics.pop("avg_indentation")
    return _docs(spark, folder).select("doc_id", *_longs(metrics), *_doubles({"avg_indentation": average}))


@query
def volume_features(spark, folder):
    hunks = V.code_hunks(_docs(spark, folder)).withColumn("code", _lined("added_lines"))
    lengths = X.length_features(F.col("added_lines"))
    peak = lengths.pop("max_line_length")
    volume = X.volume_features(F.col("added_lines"), F.col("removed_lines"), F.col("code"))
    return hunks.select("doc_id", *_longs({**volume, "max_line_length": peak}), *_doubles(lengths))


@query
def clean_code(spark, folder):
    tails = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.lit("  "), F.regexp_replace(x, F.lit("#"), F.lit("")),
        F.when(i % 3 == 0, " # note").when(i % 3 == 1, "\n \n").otherwise('\n"""\nblock\n"""')))
    return _docs(spark, folder).select("doc_id", F.md5(X.clean_code(F.array_join(tails, "\n"))).alias("cleaned"))


@query
def token_count(spark, folder):
    return _docs(spark, folder).select("doc_id", X.token_count(F.col("text")).cast("long").alias("tokens"))


@query
def code_preview(spark, folder):
    return _docs(spark, folder).select("doc_id", X.preview(F.col("text")).alias("snippet"))


@query
def context_similarity(spark, folder):
    pairs = V.turn_pairs(V.table(spark, folder, "conversations"))
    return pairs.select("conv_id", "turn", F.round(X.jaccard_words(F.col("generated"), F.col("reference")), 6)
                        .alias("similarity"))


# ------------------------------------------------------------------ syntax

def _code_nodes(spark, folder, mode="extractor") -> DataFrame:
    return SM.with_nodes(V.document_code(_docs(spark, folder)), "code", mode)


@query
def ast_metrics(spark, folder):
    return _code_nodes(spark, folder).select("doc_id", *_longs(SM.tree_metrics(F.col("nodes"))))


@query
def ast_node_counts(spark, folder):
    nodes = SM.ast_nodes(V.document_code(_docs(spark, folder)), "code", ["doc_id"])
    return SM.ast_node_counts(nodes, ["doc_id"])


@query
def code_metrics(spark, folder):
    code = V.document_code(_docs(spark, folder))
    table = SM.code_metrics(code, "code", ["doc_id"])
    return table.select("doc_id", *_longs({c: F.col(c) for c in table.columns if c not in ("doc_id", "avg_line_length")}),
                        F.round("avg_line_length", 6).alias("avg_line_length"))


@query
def cfg_metrics(spark, folder):
    f = CG.code_graph_features(F.col("nodes"))
    density = f["cfg_density"]
    return _code_nodes(spark, folder).select(
        "doc_id", *_longs({n: f[n] for n in ("cfg_nodes", "cfg_edges", "cfg_connected_components")}),
        *_doubles({"cfg_density": density}))


@query
def dep_metrics(spark, folder):
    f = CG.code_graph_features(F.col("nodes"))
    return _code_nodes(spark, folder).select(
        "doc_id", *_longs({n: f[n] for n in ("dep_nodes", "dep_edges", "function_connectivity",
                                             "variable_scope_complexity", "call_chain_depth")}),
        *_doubles({"dep_density": f["dep_density"]}))


@query
def dep_edge_rows(spark, folder):
    return CG.dep_edges(_code_nodes(spark, folder), ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"))


@query
def cfg_edge_rows(spark, folder):
    return CG.cfg_edges(_code_nodes(spark, folder), ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"))


def _snippet_nodes(spark, folder, mode="extractor") -> DataFrame:
    return SM.with_nodes(V.document_snippets(_docs(spark, folder)), "code", mode, status="status")


@query
def snippet_metrics(spark, folder):
    """Syntax and graph metrics of code with tries, raises, classes, wrapped and broken snippets, and its text's lines."""
    f = CG.code_graph_features(F.col("nodes"))
    return _snippet_nodes(spark, folder).select(
        "doc_id", "status", F.array_join(SM.function_names(F.col("nodes")), ",").alias("functions"), *_longs(SM.tree_metrics(F.col("nodes"))), *_longs({n: c for n, c in f.items() if not n.endswith("density")}),
        F.size(F.split("code", "\n")).cast("long").alias("lines"))


@query
def snippet_flow(spark, folder):
    """Control-flow edges, with the kind of node at both ends."""
    nodes = _snippet_nodes(spark, folder).select("doc_id", "nodes")
    edges = CG.cfg_edges(nodes, ["doc_id", "nodes"])

    def end(name):
        return F.concat(F.element_at("nodes", F.col(name).cast("int") + 1)["node_type"], F.lit(" "), F.col(name))

    return edges.select("doc_id", end("src").alias("src"), end("dst").alias("dst"))


@query
def snippet_dependencies(spark, folder):
    return CG.dep_edges(_snippet_nodes(spark, folder), ["doc_id"]).select("doc_id", "src", "dst")


@query
def snippet_definitions(spark, folder):
    """Nodes and edges of the definition graph."""
    nodes, edges = CG.definition_graph(_snippet_nodes(spark, folder, "raw"), ["doc_id"])
    return nodes.select("doc_id", "kind", F.col("node").alias("src"), F.lit("").alias("dst")).unionByName(
        edges.select("doc_id", "kind", "src", "dst"))


@query
def definition_graph(spark, folder):
    nodes, edges = CG.definition_graph(_code_nodes(spark, folder, "raw"), ["doc_id"])
    return (nodes.select("doc_id", F.concat(F.lit("node "), "kind").alias("part"))
            .unionByName(edges.select("doc_id", F.concat(F.lit("edge "), "kind").alias("part")))
            .groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ labels and features

def _labelled(spark, folder) -> DataFrame:
    hunks = V.code_hunks(_docs(spark, folder)).withColumn("code", _lined("added_lines"))
    parsed = SM.with_nodes(hunks, "code", "label", "label_nodes", "label_status", L.NODE_FIELDS)
    return L.quality_labels(parsed)


@query
def quality_label(spark, folder):
    return _labelled(spark, folder).select(
        "doc_id", F.round("quality_score", 6).alias("quality_score"), "is_high_quality",
        F.array_join("issues", ",").alias("issues"))


@query
def label_report(spark, folder):
    report = L.label_report(_labelled(spark, folder), by=["lang"])
    return report.select("lang", *_longs({c: F.col(c) for c in ("total_samples", "positive_samples")}), *_doubles({
        c: F.col(c) for c in ("mean", "std", "min", "max", "median", "current_threshold", "positive_ratio",
                              "recommended_threshold")}))


@query
def issue_top5(spark, folder):
    return L.top_issues(_labelled(spark, folder), 5)


@query
def issue_flags(spark, folder):
    labelled = _labelled(spark, folder)
    return labelled.select("doc_id", *_longs(L.issue_flags(F.col("issues"))))


@query
def positive_share(spark, folder):
    return E.positive_share(_labelled(spark, folder)).select(F.round("positive_share", 6).alias("positive_share"))


@query
def hunk_features(spark, folder):
    hunks = FE.with_code(V.code_hunks(_docs(spark, folder)))
    parsed = SM.with_nodes(hunks, "code", "label", "label_nodes")
    columns = FE.hunk_feature_columns(parsed)
    whole = ("lines_added", "lines_removed", "has_functions", "loop_statements", "max_indentation", "nesting_depth",
             "ast_parseable", "unique_ast_nodes", "total_ast_nodes", "files_changed", "total_hunks", "commit_size")
    return parsed.select("doc_id", *_longs({n: columns[n] for n in whole}),
                         *_doubles({n: columns[n] for n in ("context_similarity", "comment_density", "avg_indentation")}))


@query
def feature_vector(spark, folder):
    """Feature maps with missing keys, assembled on the sorted vocabulary."""
    docs = _docs(spark, folder)
    n = F.col("n_chars").cast("double")
    maps = docs.select("doc_id", F.map_filter(F.create_map(
        F.lit("chars"), n, F.lit("even"), F.when(F.col("doc_id") % 2 == 0, n * 2),
        F.lit("third"), F.when(F.col("doc_id") % 3 == 0, n * 3)), lambda k, v: v.isNotNull()).alias("features"))
    names = FE.fit_vocabulary(maps)
    values = vector_to_array("vector")
    return FE.assemble(maps, names).select("doc_id", *[values[i].alias(name) for i, name in enumerate(names)])


@query
def feature_flatten(spark, folder):
    docs = _docs(spark, folder)
    nested = docs.select("doc_id", F.struct(
        F.struct(F.col("n_chars").alias("chars"), (F.col("n_chars") > 500).alias("long")).alias("size"),
        F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("even"), F.col("lang").alias("lang"))
        .alias("info")).alias("features"))
    return FE.flatten_numeric(nested, "features")


@query
def feature_merge(spark, folder):
    docs = _docs(spark, folder)
    n = F.col("n_chars").cast("double")
    merged = FE.merge_maps(F.create_map(F.lit("a"), n, F.lit("b"), n), F.create_map(F.lit("b"), n + 1, F.lit("c"), n + 2))
    return docs.select("doc_id", *[F.element_at(merged, k).alias(k) for k in ("a", "b", "c")])


@query
def feature_rows(spark, folder):
    """Every feature of every document that SQL can tell: syntax, graphs, patterns, lines, context, issues, node counts."""
    samples = FE.labelled_features(V.code_hunks(_docs(spark, folder)))
    return samples.select("doc_id", *[F.round(F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)), 6).alias(n)
                                      for n in FEATURE_NAMES])


@query
def labelled_features(spark, folder):
    """All features of all hunks in one map-side pass: vocabulary-free summary per language."""
    samples = FE.labelled_features(V.code_hunks(_docs(spark, folder)))
    def feature(name):
        return F.element_at("features", name)
    return samples.groupBy("lang").agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.sum(feature(n)).cast("long").alias(n) for n in ("total_nodes", "dep_edges", "lines_added", "has_todo_markers",
                                                            "tokenized_length", "ast_name_count")])


# ------------------------------------------------------------------ graphs

def _event_graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    # at most 25 edges per graph, read several times: written once instead of derived each time
    edges = written(G.distinct_edges(V.event_edges(V.table(spark, folder, "events"))))
    return G.edge_nodes(edges), edges


@query
def graph_basic(spark, folder):
    nodes, edges = _event_graph(spark, folder)
    return G.basic_metrics(nodes, edges).select("graph_id", "num_nodes", "num_edges",
                                                F.round("density", 6).alias("density"), "is_connected")


@query
def graph_components(spark, folder):
    nodes, edges = _event_graph(spark, folder)
    return G.components(nodes, edges)


def _summary(values: DataFrame, column: str) -> DataFrame:
    out = G.summarize(values, column, column)
    return out.select("graph_id", *[F.round(c, 6).alias(c) for c in (f"avg_{column}", f"max_{column}")])


@query
def graph_degree(spark, folder):
    nodes, edges = _event_graph(spark, folder)
    return _summary(G.degree(nodes, edges), "degree_centrality")


@query
def graph_closeness(spark, folder):
    nodes, edges = _event_graph(spark, folder)
    return _summary(G.closeness(nodes, G.distance_sums(nodes, edges)), "closeness")


@query
def graph_betweenness(spark, folder):
    nodes, edges = _event_graph(spark, folder)
    return _summary(G.betweenness(nodes, G.distance_sums(nodes, edges)), "betweenness")


@query
def graph_clustering(spark, folder):
    nodes, edges = _event_graph(spark, folder)
    return _summary(G.clustering(nodes, edges), "clustering")


@query
def graph_paths(spark, folder):
    nodes, edges = _event_graph(spark, folder)
    paths = G.path_metrics(G.basic_metrics(nodes, edges), G.distance_sums(nodes, edges))
    return paths.select("graph_id", F.round("avg_path_length", 6).alias("avg_path_length"),
                        F.col("diameter").cast("long").alias("diameter"))


@query
def graph_defaults(spark, folder):
    """Metrics of listed graphs: those without events have zeros. One graph a user, and one more for every user."""
    events = V.table(spark, folder, "events")
    edges = written(V.event_edges(events))
    wanted = events.select(F.explode(F.array(F.concat(F.col("user_id").cast("string"), F.lit("-none")), F.concat_ws(
        "-", F.col("user_id").cast("string"), F.date_trunc("week", "ts").cast("date").cast("string")))).alias("graph_id")).distinct()
    found = G.graph_metrics(G.edge_nodes(edges), edges, graphs=wanted)
    return found.select("graph_id", *[F.col(f"basic_metrics.{c}") for c in ("num_nodes", "num_edges", "is_connected")],
                        F.round("structural_metrics.avg_path_length", 6).alias("avg_path_length"),
                        F.col("structural_metrics.diameter").cast("long").alias("diameter"))


@query
def graph_features(spark, folder):
    """Everything per graph."""
    nodes, edges = _event_graph(spark, folder)
    metrics = G.graph_metrics(nodes, edges)
    flat = FE.flatten_numeric(metrics.select("graph_id", F.struct(
        "basic_metrics", "centrality_measures", "structural_metrics").alias("g")), "g")
    return flat.select("graph_id", *[F.round(c, 6).alias(c) for c in flat.columns if c != "graph_id"])


# ------------------------------------------------------------------ evaluation

def _scored(spark, folder) -> DataFrame:
    return V.binary_scores(_docs(spark, folder), V.table(spark, folder, "labels"))


@query
def class_distribution(spark, folder):
    return E.class_distribution(V.table(spark, folder, "labels"), "quality").select(
        F.col("label").cast("long").alias("label"), "n", "total", "has_both")


@query
def class_weights(spark, folder):
    return E.class_weights(V.table(spark, folder, "labels"), "quality").select(
        F.col("label").cast("long").alias("label"), F.round("weight", 6).alias("weight"))


@query
def majority_prediction(spark, folder):
    labels = V.table(spark, folder, "labels")
    model = M.majority_class(labels, "quality")
    scored = model.transform(labels)
    return scored.select("doc_id", F.col("model_prediction").cast("long").alias("prediction"))


@query
def stratified_split(spark, folder):
    labels = V.table(spark, folder, "labels")
    return S.stratified_split(labels, ["doc_id"], "quality").select("doc_id", "split")


@query
def three_way_split(spark, folder):
    labels = V.table(spark, folder, "labels")
    return S.stratified_split(labels, ["doc_id"], None, test=0.1, validation=0.1).select("doc_id", "split")


@query
def hash_sample(spark, folder):
    return S.hash_sample(_docs(spark, folder), ["doc_id"], 100).select("doc_id")


@query
def oversample(spark, folder):
    """One-class rows and jittered rows of the other class: rows, distinct keys, and the kept rows' keys."""
    good = V.table(spark, folder, "labels").where("quality = 1").join(_docs(spark, folder), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.array(F.col("n_chars").cast("double"), F.lit(1.0)).alias("features"))
    grown = S.oversample_single_class(good, ["doc_id"])
    return grown.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_keys"),
        F.sum(F.when(F.col("label") == 1, F.col("doc_id")).otherwise(0)).alias("sum_of_kept_keys"),
        F.min(F.element_at("features", 2)).alias("constant_feature"))


@query
def cls_metrics(spark, folder):
    return E.classification_metrics(_scored(spark, folder)).select(
        *_doubles({c: F.col(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")}))


@query
def model_comparison(spark, folder):
    """Three models at once: a score, its opposite, and a constant prediction that must be re-thresholded."""
    scored = _scored(spark, folder)
    p = F.col("probability")
    models = F.explode(F.array(
        F.struct(F.lit("score").alias("model"), p.alias("probability"), F.col("prediction").alias("prediction")),
        F.struct(F.lit("opposite").alias("model"), (1 - p).alias("probability"), (1 - p > 0.5).cast("int").alias("prediction")),
        F.struct(F.lit("constant").alias("model"), p.alias("probability"), F.lit(0).alias("prediction")))).alias("m")
    table = scored.select("doc_id", "label", models).select("doc_id", "label", "m.*")
    return E.classification_metrics(table, ["model"]).select(
        "model", *_doubles({c: F.col(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")}))


@query
def evaluate_tasks(spark, folder):
    """A table with two classification tasks and a generation task."""
    scored = _scored(spark, folder).select("label", "prediction", "probability")
    other = scored.select("label", (1 - F.col("prediction")).alias("prediction"), (1 - F.col("probability")).alias("probability"))
    texts = V.turn_pairs(V.table(spark, folder, "conversations")).withColumn("task", F.lit("comment"))
    rows = scored.withColumn("task", F.lit("quality")).unionByName(other.withColumn("task", F.lit("classification"))).unionByName(
        texts, allowMissingColumns=True)
    found = E.evaluate_tasks(rows, key=["conv_id", "turn"], stem=False, scores=("bleu", "rouge1", "rouge2"))
    return found.select("task", "metric", F.round("value", 6).alias("value"))


@query
def cls_report(spark, folder):
    report = E.classification_report(_scored(spark, folder))
    return report.select("name", *_doubles({c: F.col(c) for c in ("precision", "recall", "f1")}),
                         F.col("support").cast("long").alias("support"))


@query
def confusion(spark, folder):
    return E.confusion_matrix(_scored(spark, folder)).select(
        F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"), "n")


@query
def roc_auc(spark, folder):
    """Exact area per language over a continuous score."""
    docs = _docs(spark, folder)
    scored = V.table(spark, folder, "labels").join(docs, "doc_id").select(
        "lang", F.col("quality").alias("label"), (F.col("n_chars") % 997 / 997.0).alias("probability"))
    return E.roc_auc(scored, ["lang"]).select("lang", F.round("roc_auc", 6).alias("roc_auc"))


@query
def bleu(spark, folder):
    pairs = V.turn_pairs(V.table(spark, folder, "conversations"))
    scores = TM.pair_scores(pairs, ["conv_id", "turn"], stem=False, scores=("bleu",))
    return scores.select("conv_id", "turn", F.round("bleu", 6).alias("bleu"))


@query
def rouge12(spark, folder):
    pairs = V.turn_pairs(V.table(spark, folder, "conversations"))
    scores = TM.pair_scores(pairs, ["conv_id", "turn"], stem=False, scores=("rouge1", "rouge2"))
    return scores.select("conv_id", "turn", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@query
def generation_metrics(spark, folder):
    """Averages per tenth of the conversations, stemmed; longest common subsequence included."""
    pairs = V.turn_pairs(V.table(spark, folder, "conversations")).withColumn("part", F.col("conv_id") % 10)
    scores = TM.generation_metrics(pairs, ["conv_id", "turn"], by=["part"])
    return scores.select("part", *_doubles({c: F.col(c) for c in ("bleu", "rouge1", "rouge2", "rougeL")}))


# ------------------------------------------------------------------ pooling and models

# Width of the embeddings, and output weights of the attention; its hidden weights follow from a rule.
EMBEDDING_WIDTH = 64
ATTENTION_OUTPUT = [1.0, -0.5, 0.75, 0.25]


def _bags(spark, folder) -> DataFrame:
    table = V.table(spark, folder, "embeddings")
    width = F.size("embedding")
    hidden = [[((h * 7 + d * 3) % 5 - 2) / 10 for d in range(EMBEDDING_WIDTH)] for h in range(len(ATTENTION_OUTPUT))]
    score = F.when(width == EMBEDDING_WIDTH, P.attention_scores(F.col("embedding"), hidden, ATTENTION_OUTPUT))
    return table.select("vec_id", F.col("label").alias("bag"), "embedding", score.alias("score"))


@query
def mil_attention(spark, folder):
    weights = P.attention_weights(_bags(spark, folder), "bag", "score")
    return weights.select("vec_id", F.col("bag").cast("long").alias("bag"),
                          F.round("attention_weight", 6).alias("attention_weight"))


@query
def mil_pool(spark, folder):
    pooled = P.attention_pool(_bags(spark, folder), "bag", "embedding", "score")
    return pooled.select(F.col("bag").cast("long").alias("bag"), "instances",
                         F.posexplode("pooled").alias("dim", "value")).select(
        "bag", "instances", F.col("dim").cast("long").alias("dim"), F.round("value", 5).alias("value"))


@query
def mil_predict(spark, folder):
    """Score, softmax, pool and a head with a hidden layer, per bag."""
    pooled = P.attention_pool(_bags(spark, folder), "bag", "embedding", "score")
    hidden = [[((h * 5 + d * 2) % 7 - 3) / 10 for d in range(EMBEDDING_WIDTH)] for h in range(3)]
    found = P.bag_prediction(pooled, [0.8, -0.6, 0.4], 0.1, hidden=hidden, hidden_bias=[0.0, 0.1, -0.1])
    return found.select(F.col("bag").cast("long").alias("bag"), F.round("probability", 5).alias("probability"))


@query
def attention_report(spark, folder):
    """Attention of each hunk within its commit, with file and size."""
    parsed = D.patch_hunks(V.document_patches(_docs(spark, folder)))
    hunks = written(P.with_line_counts(parsed).select(
        "commit_hash", "file_idx", "hunk_idx", "file_path", "lines_added", "lines_removed", (F.col("lines_added") / 10.0).alias("score")))
    report = P.attention_report(P.attention_weights(hunks, "commit_hash", "score"), ["commit_hash", "file_idx", "hunk_idx"])
    return report.select("commit_hash", "file_path", *_longs({c: F.col(c) for c in ("hunk_idx", "lines_added", "lines_removed")}),
                         F.round("attention_weight", 6).alias("attention_weight"))


def _matrix(spark, folder) -> tuple[DataFrame, list[str]]:
    """Labelled documents with a few line features, as a vector with names."""
    docs = V.table(spark, folder, "labels").join(_docs(spark, folder), "doc_id")
    lines = F.split("text", "\n")
    values = {**X.line_metrics(lines), **X.regex_features(F.col("text"))}
    maps = docs.select("doc_id", F.col("quality").alias("label"), F.map_from_arrays(
        F.array(*[F.lit(n) for n in values]), F.array(*[c.cast("double") for c in values.values()])).alias("features"))
    names = sorted(values)
    return FE.assemble(maps, names).select("doc_id", "label", "vector"), names


def _split_matrix(spark, folder):
    matrix, names = _matrix(spark, folder)
    split = checkpointed(S.stratified_split(checkpointed(matrix), ["doc_id"]))
    return split.where("split = 'train'"), split.where("split = 'test'"), names


@query
def lr_predict(spark, folder):
    train, test, _ = _split_matrix(spark, folder)
    models = M.train_baselines(train, ["doc_id"], models=("logistic",))
    return M.predict_all(models, test, ["doc_id"])


@query
def model_round_trip(spark, folder):
    """Models saved, loaded and asked again: every test row gets the same answer, and the vocabulary is that of the fit."""
    train, test, names = _split_matrix(spark, folder)
    models = M.train_baselines(train, ["doc_id"], models=("logistic", "random_forest"), trees=10, depth=5)
    path = _folder(spark)
    M.save_models(models, names, path, spark)
    loaded, vocabulary = M.load_models(path, spark)
    again = M.predict_all(loaded, test, ["doc_id"]).withColumnsRenamed({"prediction": "p2", "probability": "q2"}).drop("label")
    both = M.predict_all(models, test, ["doc_id"]).join(again, ["doc_id", "model"])
    known = vocabulary == names and M.models_exist(path, spark) and not M.models_exist(f"{path}/none", spark)
    return both.select("doc_id", "model", ((F.col("prediction") == F.col("p2")) & (F.col("probability") == F.col("q2")) & F.lit(
        known)).alias("same"), (F.col("prediction") == (F.col("probability") > 0.5).cast("int")).alias("consistent"))


@query
def rf_importance(spark, folder):
    train, _, names = _split_matrix(spark, folder)
    models = M.train_baselines(train, ["doc_id"], models=("random_forest",))
    return XP.feature_importance(models["random_forest"], names, spark)


@query
def svm_predict(spark, folder):
    train, test, _ = _split_matrix(spark, folder)
    models = M.train_baselines(train, ["doc_id"], models=("svm",))
    return M.predict_all(models, test, ["doc_id"])


@query
def mlp_quality(spark, folder):
    """Half of the classes against the other half: fitted on four fifths of the vectors, predictions for the last fifth."""
    whole = V.table(spark, folder, "embeddings").select(
        "vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"))
    split = written(S.stratified_split(whole, ["vec_id"]))
    model = M.embedding_quality_head(split.where("split = 'train'").coalesce(8), width=EMBEDDING_WIDTH)
    table = split.where("split = 'test'")
    vectors = table.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    return M.predict_all({"embedding_head": model}, vectors, ["vec_id"])


@query
def shap_linear(spark, folder):
    train, test, _ = _split_matrix(spark, folder)
    models = M.train_baselines(train, ["doc_id"], models=("logistic",))
    return XP.mean_absolute(XP.linear_attributions(models["logistic"], test, ["doc_id"]))


@query
def shap_forest(spark, folder):
    """Attributions of the forest's probability for every row: do they add up, and is every feature's share a number?"""
    train, test, _ = _split_matrix(spark, folder)
    model = M.train_baselines(train, ["doc_id"], models=("random_forest",))["random_forest"]
    rows = train.unionByName(test)
    found = XP.forest_attributions(model, rows, ["doc_id"])
    scored = M.predict_all({"forest": model}, rows, ["doc_id"], None).select("doc_id", "probability")
    total = F.col("base") + F.aggregate("attributions", F.lit(0.0), lambda acc, x: acc + x)
    return found.join(scored, "doc_id").select(
        "doc_id", (F.abs(total - F.col("probability")) < 1e-9).alias("adds_up"),
        F.forall("attributions", lambda x: F.abs(x) <= 1).alias("bounded"))


@query
def permutation_importance(spark, folder):
    train, test, names = _split_matrix(spark, folder)
    models = M.train_baselines(train, ["doc_id"], models=("logistic",))
    return XP.permutation_importance(models["logistic"], test, ["doc_id"], names)


@query
def score_batches(spark, folder):
    """A user model on executors: here the mean of each embedding, squashed."""
    def make():
        import numpy as np

        return lambda batch: 1 / (1 + np.exp(-batch.mean(axis=1).astype("float64")))

    table = V.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scored = table.withColumn("quality_score", H.predict_arrays(make, 64)(F.col("v")))
    return scored.select("vec_id", F.round("quality_score", 6).alias("quality_score"))


# ------------------------------------------------------------------ review

def _review_inputs(spark, folder) -> DataFrame:
    return RV.with_review_inputs(V.code_hunks(_docs(spark, folder)).withColumn("line_start", F.lit(1)))


@query
def review_comments(spark, folder):
    """Comments with one model's flag and a deep score, both taken from the document's length."""
    docs = _docs(spark, folder).select("doc_id", "n_chars")
    p = (F.col("n_chars") % 101) / 100.0
    inputs = _review_inputs(spark, folder)
    scored = inputs.join(docs, "doc_id").withColumns({
        "random_forest_probability": p, "random_forest_prediction": (p > 0.5).cast("double"), "deep": p})
    out = RV.review_comments(scored, ["random_forest"], "deep")
    return out.select("doc_id", F.array_join("comments", "|").alias("comments"))


@query
def combined_feedback(spark, folder):
    """Local comments and a stub external answer merged for each hunk."""
    answer = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("assessment"), F.lit("none").alias("issues"),
        F.lit("").alias("security")))).when(F.col("doc_id") % 3 == 1, '{"error": "timeout"}')
    inputs = _review_inputs(spark, folder).withColumn("answer", R.parse_review(answer))
    reviewed = RV.comprehensive_review(RV.review_comments(inputs), "answer")
    return reviewed.select("doc_id", F.array_join("review.combined_feedback", "|").alias("feedback"))


def _code_patches(spark, folder) -> DataFrame:
    code = V.document_code(_docs(spark, folder))
    path = F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return code.select(V.document_hash(F.col("doc_id")).alias("commit_hash"),
                       D.snapshot_patch(path, F.lit("A"), F.col("code")).alias("patch"))


@query
def review_rows(spark, folder):
    """Patches of new code files to comment rows, end to end."""
    return PL.review_table(_code_patches(spark, folder)).select(
        "commit_hash", "file_path", F.col("line_number").cast("long").alias("line_number"),
        F.col("comment_idx").cast("long").alias("comment_idx"), "comment")


@query
def review_prose(spark, folder):
    """The same over patches of the documents themselves: comments per change type."""
    reviewed = PL.review(V.document_patches(_docs(spark, folder)))
    rows = reviewed.select("change_type", F.explode("review.combined_feedback").alias("comment"))
    kind = F.when(F.col("comment").rlike("^(Added|Removed|Modified) "),
                  F.regexp_extract("comment", "^(Added|Removed|Modified)", 1)).otherwise(F.col("comment"))
    return rows.groupBy("change_type", kind.alias("comment")).agg(F.count(F.lit(1)).alias("n"))


@query
def review_prompt(spark, folder):
    hunks = H.with_prompt(V.code_hunks(_docs(spark, folder)))
    return hunks.select("doc_id", F.md5("prompt").alias("prompt"))


@query
def external_parse(spark, folder):
    """Answers in four shapes: JSON, fenced JSON, plain text, error."""
    doc = F.col("doc_id")
    body = F.concat(F.lit('{"assessment": "a'), doc.cast("string"), F.lit('", "issues": "i"}'))
    answer = (F.when(doc % 4 == 0, body).when(doc % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .when(doc % 4 == 2, F.concat(F.lit("plain "), doc.cast("string"))).otherwise('{"error": "down"}'))
    parsed = _docs(spark, folder).select("doc_id", R.parse_review(answer).alias("r"))
    return parsed.select("doc_id", "r.assessment", "r.issues", "r.analysis", "r.error")


@query
def external_review(spark, folder):
    """Prompts sent through the executor-side hook to a stub client."""
    def factory():
        return lambda text: '{"assessment": "%d characters"}' % len(text)

    prompts = H.with_prompt(V.code_hunks(_docs(spark, folder))).select("doc_id", "prompt")
    answers = H.external_review(prompts, factory)
    return answers.select("doc_id", R.parse_review(F.col("answer_text"))["assessment"].alias("assessment"))


@query
def explain_samples(spark, folder):
    """Explanation rows for all samples, with importance taken from mean feature values."""
    samples = checkpointed(FE.labelled_features(V.code_hunks(_docs(spark, folder))).select(
        "doc_id", "code", "features", "is_high_quality", "quality_score", "issues"))
    names = ("num_functions", "num_classes", "num_loops", "returns", "assignments", "function_calls")
    means = samples.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("feature"), F.element_at("features", n).alias("value")) for n in names])).alias("x"))
    importance = means.groupBy("x.feature").agg(F.avg("x.value").alias("importance"))
    explained = XP.explain_samples(samples, importance, ["doc_id"], n=None)
    return explained.select("doc_id", "code_snippet", "predicted_quality", F.array_join("key_issues", ",").alias("issues"),
                            F.array_join(F.transform("top_features", lambda t: F.concat(
                                t["feature"], F.lit("="), t["value"].cast("long").cast("string"))), ",").alias("top"))


@query
def synthetic_commits(spark, folder):
    """One generated commit per document id."""
    hunks = ST.synthetic_hunks(_docs(spark, folder).select(F.col("doc_id").alias("n")))
    return hunks.select("commit_hash", "message", F.col("line_end").cast("long").alias("line_end"),
                        F.md5(_lined("added_lines")).alias("added"))
