"""Feature columns of hunks, feature maps, and the dense matrix for learning.

All features of a hunk are computed inside its own row, so a hunk table of any size becomes a feature table with a
single map-side stage.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffscope.functions import text as X
from diffscope.functions.syntax import FIELDS, parse_both
from diffscope.operators.code_graph import code_graph_features
from diffscope.operators.labels import issue_flags, quality_labels
from diffscope.operators.syntax_metrics import label_metrics, node_count_map, node_types, tree_metrics

UNUSED = ("node_id", "parent_id", "def_depth", "owner")  # node fields that no feature and no label reads

def with_code(hunks: DataFrame) -> DataFrame:
    """Keep hunks with added text and add their code."""
    return hunks.where(X.has_added_text(F.col("added_lines"))).withColumn("code", X.join_lines(F.col("added_lines")))


def with_parses(hunks: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Add `nodes`, `label_nodes` and `label_status` of `code`, in one pass through the Python workers; nodes have `fields`."""
    parsed = hunks.withColumn("_parsed", parse_both(F.col("code"), fields))
    return parsed.withColumns({
        "nodes": F.col("_parsed.nodes"),
        "label_nodes": F.coalesce("_parsed.label_nodes", "_parsed.nodes"),
        "label_status": F.col("_parsed.label_status")}).drop("_parsed")


def context_features(df: DataFrame, lines_added: Column) -> dict[str, Column]:
    """Commit context; without it a hunk counts as a commit of its own."""
    def known(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("int")

    return {
        "files_changed": F.coalesce(known("files_changed"), F.lit(1)),
        "total_hunks": F.coalesce(known("total_hunks"), F.lit(1)),
        "commit_size": F.coalesce(known("commit_size"), lines_added),
    }


def hunk_feature_columns(df: DataFrame) -> dict[str, Column]:
    """Line, pattern, indentation and context features of a hunk table with `code` and `label_nodes`."""
    added, code = F.col("added_lines"), F.col("code")
    volume = X.volume_features(added, F.col("removed_lines"), code)
    similarity = F.when(F.size("context_lines") > 0,
                        X.jaccard_words(code, X.join_lines(F.col("context_lines")))).otherwise(F.lit(0.0))
    return {
        **volume,
        **X.regex_features(code),
        **X.length_features(added),
        **X.indent_features(X.indents(added)),
        "context_similarity": similarity,
        **context_features(df, volume["lines_added"]),
        **label_metrics(F.col("label_nodes")),
    }


def hunk_features(hunks: DataFrame) -> DataFrame:
    """Hunks (with `code`, `label_nodes`) plus their feature columns."""
    columns = hunk_feature_columns(hunks)
    return hunks.withColumns(columns)


def with_feature_map(df: DataFrame) -> DataFrame:
    """Add features MAP<STRING,DOUBLE> to labelled hunks with `code`, `nodes`, `label_nodes` and `issues`.

    Later groups win where names meet: syntax, code graph, hunk features, cleaning and issue flags, node counts.
    """
    df = df.withColumn("_types", node_types(F.col("nodes")))  # read often, so the optimizer leaves it a column of its own
    nodes, types = F.col("nodes"), F.col("_types")
    groups = {
        **tree_metrics(nodes, types),
        **code_graph_features(nodes),
        **hunk_feature_columns(df),
        "tokenized_length": X.token_count(X.clean_code(F.col("code"))),
        "has_syntax_errors": 1 - (F.size("label_nodes") > 0).cast("int"),
        **issue_flags(F.col("issues")),
    }
    fixed = F.map_from_arrays(F.array(*[F.lit(n) for n in groups]),
                              F.array(*[c.cast("double") for c in groups.values()]))
    # node counts are named ast_<type>_count, which no fixed name is
    return df.withColumn("features", F.map_concat(fixed, node_count_map(nodes, types))).drop("_types")


def labelled_features(hunks: DataFrame) -> DataFrame:
    """Hunks to samples: code, features, quality_score, is_high_quality, issues.

    Hunks without added text, or with nothing left after cleaning, are no samples.
    """
    parsed = with_parses(with_code(hunks).where(X.not_blank(X.clean_code(F.col("code")))),
                         tuple(name for name in FIELDS if name not in UNUSED))
    return with_feature_map(quality_labels(parsed)).drop("nodes", "label_nodes", "label_status")


def flatten_numeric(df: DataFrame, column: str, separator: str = "_") -> DataFrame:
    """Expand a nested struct into DOUBLE columns named by their path; null and non-numeric leaves become 0."""
    out: list[Column] = []

    def visit(prefix: str, value: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                name = f"{prefix}{separator}{field.name}" if prefix else field.name
                visit(name, value[field.name], field.dataType)
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            out.append(F.coalesce(value.cast("double"), F.lit(0.0)).alias(prefix))
        else:
            out.append(F.lit(0.0).alias(prefix))

    visit("", F.col(column), df.schema[column].dataType)
    return df.select(*[c for c in df.columns if c != column], *out)


def _without_keys(entries: Column, other: Column) -> Column:
    return F.map_filter(entries, lambda k, v: ~F.array_contains(F.map_keys(other), k))


def merge_maps(*maps: Column) -> Column:
    """Merge feature maps; the later map wins for a shared key (independent of the session's map policy)."""
    merged = maps[0]
    for later in maps[1:]:
        merged = F.map_concat(_without_keys(merged, later), later)
    return merged


def fit_vocabulary(df: DataFrame, column: str = "features") -> list[str]:
    """Sorted distinct feature names, learned once and stored with the models.

    They are the positions of a dense vector, so they come to the driver as the width of every row's vector does; names come
    from a fixed set of metrics and the node types of a grammar. The distinct runs on the cluster, combined in tasks first.
    """
    names = df.select(F.explode(F.map_keys(column)).alias("name")).where("name IS NOT NULL").distinct()
    return [r["name"] for r in names.orderBy("name").collect()]


def assemble(df: DataFrame, vocabulary: list[str], column: str = "features", output: str = "vector") -> DataFrame:
    """Feature map to a dense vector in vocabulary order; missing is 0, unknown names are ignored.

    The names travel in the vector's column metadata, where importances and attributions find them.
    """
    names = F.array(*[F.lit(n) for n in vocabulary])
    # bound once: inside the lambda the optimizer would otherwise put the whole feature computation, once per name
    values = X.let(F.col(column), lambda features: F.transform(
        names, lambda n: F.coalesce(F.try_element_at(features, n), F.lit(0.0))))
    # always true, but not deterministic: keeps the vector a column of its own. Spark cannot hand an input that holds a
    # lambda to a Python stage of a model, and would recompute the vector for every use in a pipeline.
    values = F.when(F.monotonically_increasing_id() >= 0, values)
    attributes = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(vocabulary)]},
                              "num_attrs": len(vocabulary)}}
    return df.withColumn(output, array_to_vector(values).alias(output, metadata=attributes)) \
        .withMetadata(output, attributes)


def feature_names(df: DataFrame, column: str = "vector") -> list[str]:
    """Names stored in a vector column's metadata."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"]
    found = sorted((a["idx"], a["name"]) for attrs in groups.values() for a in attrs)
    return [name for _, name in found]
