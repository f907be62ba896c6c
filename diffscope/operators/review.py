"""Review comments for hunk tables: everything is added inside the hunk's row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffscope.functions import review_text as R
from diffscope.functions.syntax import FIELDS
from diffscope.functions.text import has_added_text
from diffscope.operators.labels import NODE_FIELDS, quality_labels
from diffscope.operators.features import with_parses
from diffscope.operators.syntax_metrics import tree_metrics


def with_review_inputs(hunks: DataFrame, keep_nodes: bool = False) -> DataFrame:
    """Add code, issues, quality label, cyclomatic_complexity, num_functions and ast_parseable to hunks."""
    parsed = with_parses(hunks.withColumn("code", F.array_join("added_lines", "\n")), FIELDS if keep_nodes else NODE_FIELDS)
    tree = tree_metrics(F.col("nodes"))
    inputs = quality_labels(parsed).withColumns({
        "cyclomatic_complexity": tree["cyclomatic_complexity"],
        "num_functions": tree["num_functions"],
        "ast_parseable": (F.size("label_nodes") > 0).cast("int")})
    return inputs if keep_nodes else inputs.drop("nodes", "label_nodes", "label_status")


def review_comments(df: DataFrame, models: list[str] = (), score: str | None = None,
                    report_syntax: bool = True) -> DataFrame:
    """Add `comments` ARRAY<STRING> to rows with issues, cyclomatic_complexity and num_functions.

    `models` names baseline models whose <name>_prediction and <name>_probability columns are present; `score` names a
    deep model's score column. `report_syntax` adds the syntax comment for code that does not parse.
    """
    issues = F.col("issues")
    if report_syntax and "ast_parseable" in df.columns:
        missing = (F.col("ast_parseable") == 0) & ~F.array_contains(issues, "unparseable_syntax")
        issues = F.when(missing, F.array_append(issues, F.lit("unparseable_syntax"))).otherwise(issues)
    flags = [R.model_comment(m, F.col(f"{m}_prediction"), F.col(f"{m}_probability")) for m in models]
    comments = R.review_comments_array(issues, F.col("cyclomatic_complexity"), F.col("num_functions"), flags,
                                       F.col(score) if score else None)
    return df.withColumn("comments", comments)


def comprehensive_review(df: DataFrame, answer: str | None = None, word_counts: bool = False) -> DataFrame:
    """Add `review` STRUCT<local_analysis, external_analysis, combined_feedback> to rows with `comments`.

    Hunks without added text get no local analysis. `answer` names a parsed external answer (see `parse_review`).
    """
    added, removed = F.array_join("added_lines", "\n"), F.array_join("removed_lines", "\n")
    has_code = has_added_text(F.col("added_lines"))
    local = F.when(has_code, F.struct(
        F.col("comments").alias("comments"),
        F.size("added_lines").alias("code_lines_analyzed"),
        F.size("added_lines").alias("total_lines_available")))
    external = F.col(answer) if answer else F.lit(None).cast(R.ANSWER_DDL)
    feedback = R.combined_feedback(removed, added, F.when(has_code, F.col("comments")),
                                   F.col(answer) if answer else None, word_counts)
    return df.withColumn("review", F.struct(
        local.alias("local_analysis"), external.alias("external_analysis"), feedback.alias("combined_feedback")))


def comment_rows(reviews: DataFrame, key: list[str]) -> DataFrame:
    """One row per feedback line: file_path, line_number, comment, commit_hash, comment_idx plus `key`."""
    kept = list(dict.fromkeys([*key, "commit_hash", "file_path"]))
    # outer: feedback is never empty, and a plain explode would make the optimizer repeat the review in a filter
    return reviews.select(
        *kept, F.col("line_start").alias("line_number"),
        F.posexplode_outer("review.combined_feedback").alias("comment_idx", "comment"))
