"""Heuristic quality labels as one chained DOUBLE expression per hunk, and reports over label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.functions.text import (_word, count_comments, count_nonblank, indents, join_lines, not_blank)
from diffscope.operators.distances import matched
from diffscope.operators.ordered import order_key, running_total
from diffscope.operators.syntax_metrics import has_docstring, nesting_depth
from diffscope.session import written

GOOD_ABOVE = 0.45
NODE_FIELDS = ("node_type", "ctl_depth", "is_docstr")  # what a label reads of a node

_TAIL = r".*:[\s\x1c-\x1f]*$"

# Pattern, name and weight, applied in this order; each counts at most three times.
PATTERN_WEIGHTS = (
    ("(?dmU)" + _word("if") + _TAIL, "conditional", 0.05),
    ("(?dmU)" + _word("try") + _TAIL, "error_handling", 0.1),
    ("(?dmU)" + _word("for") + _TAIL, "loop", 0.0),
    ("(?dmU)" + _word("while") + _TAIL, "while_loop", -0.05),
    ("(?dmU)" + _word("def") + _TAIL, "function_def", 0.1),
    ("(?dmU)" + _word("class") + _TAIL, "class_def", 0.15),
    ("TODO|FIXME|XXX", "todo_markers", -0.1),
    (r"print\(|console\.log", "debug_prints", -0.15),
    (r"(?U)import[\s\x1c-\x1f]+\*", "wildcard_import", -0.2),
)
# Issues that become 0/1 feature columns.
FLAG_ISSUES = (
    "empty_change", "very_long_change", "long_change", "no_comments", "todo_markers", "debug_prints", "long_lines",
    "deep_nesting", "inconsistent_indentation", "unparseable_syntax",
)


def _delta(*cases: tuple[Column, float]) -> Column:
    """First matching case's change of the score, else 0 (adding 0.0 leaves a DOUBLE as it is)."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, value in cases[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(0.0))


def label_struct(added: Column, nodes: Column, status: Column | None = None) -> Column:
    """STRUCT<quality_score, issues> of the added lines and their `label` node array.

    The order of the additions is part of the result (floating point against a sharp threshold): do not rearrange.
    Code that does not parse is not penalised; only a parser that gave up (status `limit`) is.
    """
    code = join_lines(added)
    count = count_nonblank(added)
    ratio = F.try_divide(count_comments(added).cast("double"), count.cast("double"))
    uncommented = (ratio == 0) & (count > 10)
    issues: list[Column] = [
        F.when(count > 50, "very_long_change").when(count > 20, "long_change"),
        F.when(uncommented, "no_comments"),
    ]
    score = F.lit(0.5) + _delta((count > 50, -0.2), (count > 20, -0.1))
    score = score + _delta((ratio > 0.2, 0.1), (uncommented, -0.1))
    for pattern, name, weight in PATTERN_WEIGHTS:
        found = F.regexp_count(code, F.lit(pattern))
        if weight:
            score = score + F.lit(weight) * F.least(found, F.lit(3)).cast("double")
        if weight < 0:
            issues.append(F.when(found > 0, f"{name}_detected"))
    long_lines = F.size(F.filter(added, lambda x: F.length(x) > 100))
    score = score - F.lit(0.05) * F.least(long_lines, F.lit(5)).cast("double")
    issues.append(F.when(long_lines > 0, "long_lines"))
    variety = F.size(F.array_distinct(indents(added)))
    score = score + _delta((variety > 4, -0.1))
    issues.append(F.when(variety > 4, "inconsistent_indentation"))
    depth = nesting_depth(nodes)
    score = score + _delta((depth > 4, -0.1), (depth > 2, -0.05))
    issues.append(F.when(depth > 4, "deep_nesting"))
    score = score + _delta((has_docstring(nodes), 0.1))
    if status is not None:
        score = score + _delta((status == "limit", -0.2))
        issues.append(F.when(status == "limit", "unparseable_syntax"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

    blank = ~not_blank(code)
    score = F.when(blank, F.lit(0.0)).otherwise(score)
    found_issues = F.when(blank, F.array(F.lit("empty_change"))).otherwise(F.array_compact(F.array(*issues)))
    return F.struct(score.alias("quality_score"), found_issues.alias("issues"))


def quality_labels(hunks: DataFrame, nodes: str = "label_nodes", status: str | None = "label_status") -> DataFrame:
    """Add quality_score, is_high_quality and issues to hunks that carry their `label` nodes."""
    has_status = status is not None and status in hunks.columns
    labelled = hunks.withColumn("_label", label_struct(F.col("added_lines"), F.col(nodes),
                                                       F.col(status) if has_status else None))
    return (labelled.withColumn("quality_score", F.col("_label.quality_score"))
            .withColumn("is_high_quality", F.col("quality_score") > F.lit(GOOD_ABOVE))
            .withColumn("issues", F.col("_label.issues")).drop("_label"))


def canonical_issues(issues: Column) -> Column:
    """Issue names without the `_detected` suffix."""
    return F.transform(issues, lambda x: F.regexp_replace(x, F.lit("_detected$"), F.lit("")))


def issue_flags(issues: Column) -> dict[str, Column]:
    names = canonical_issues(issues)
    return {f"has_{name}": F.array_contains(names, name).cast("int") for name in FLAG_ISSUES}


def top_issues(labels: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent issues; ties by name. (A plain explode would make the optimizer repeat the labelling as a filter.)"""
    return (labels.select(F.explode_outer("issues").alias("issue")).where("issue is not null").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "issue").limit(k))


def score_counts(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per distinct score. Scores are sums of few fixed steps, so this is small however many hunks there are."""
    return labels.groupBy(*(by or []), "quality_score").agg(F.count(F.lit(1)).alias("n"))


def percentiles(counts: DataFrame, by: list[str], value: str, n: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column per share): exact percentiles, linear between neighbours, of values with their frequencies.

    The values at a rank are the least whose running count is above it, so no group is sorted or held as a whole.
    """
    ranked = running_total(counts.select(*by, value, n), by, order_key(counts, value), [], F.col(n), "_upto")
    totals = counts.groupBy(*by).agg(F.sum(n).alias("_all"))
    placed = matched(ranked, totals, by)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col(value)))

    def between(share: float) -> Column:
        place = F.lit(share) * (F.col("_all") - 1)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.min(place - F.floor(place))
        return low + (high - low) * part

    return placed.groupBy(*by).agg(*[between(share).alias(name) for name, share in shares.items()])


def label_report(labels: DataFrame, threshold: float = GOOD_ABOVE, by: list[str] | None = None) -> DataFrame:
    """Score statistics and threshold analysis, one row (per group); no row for an empty input.

    Percentiles are exact. The deviation is taken from the mean in a second pass over the counts.
    """
    s, n = F.col("quality_score"), F.col("n")
    counts = written(score_counts(labels, by).withColumn("_one", F.lit(1)))
    wanted, by = by or [], by or ["_one"]
    total = F.sum("n")
    means = counts.groupBy(*by).agg((F.sum(s * n) / total).alias("mean"))
    report = matched(counts, means, by).groupBy(*by).agg(
        total.alias("total_samples"), F.max("mean").alias("mean"),
        F.sqrt(F.sum((s - F.col("mean")) * (s - F.col("mean")) * n) / total).alias("std"),
        F.min(s).alias("min"), F.max(s).alias("max"),
        F.sum(F.when(s > F.lit(threshold), n).otherwise(0)).alias("positive_samples")).where(F.col("total_samples") > 0)
    ranks = percentiles(counts, by, "quality_score", "n", {"median": 0.5, "recommended_threshold": 0.7})
    return matched(report, ranks, by).select(
        *wanted, "total_samples", "mean", "std", "min", "max", "median", F.lit(threshold).alias("current_threshold"),
        "positive_samples", (F.col("positive_samples") / F.col("total_samples")).alias("positive_ratio"),
        "recommended_threshold")
