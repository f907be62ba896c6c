"""End-to-end plans: training and review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffscope.operators import models as M
from diffscope.operators.diff import hunk_key, patch_hunks
from diffscope.operators.evaluate import classification_metrics
from diffscope.operators.explain import explain_samples, feature_importance
from diffscope.operators.features import assemble, fit_vocabulary, labelled_features, with_feature_map
from diffscope.operators.review import comment_rows, comprehensive_review, review_comments, with_review_inputs
from diffscope.operators.sampling import stratified_split
from diffscope.sources.patches import METADATA
from diffscope.sources.tables import padded_hunks


def train(hunks: DataFrame, path: str, force: bool = False, explained: int | None = None,
          pad_to: int | None = None, **model_options) -> dict:
    """Features, labels, split, baselines, evaluation and explanations; models and vocabulary are stored at `path`.

    Returns status, metrics, importance, explanations (DataFrames), models and vocabulary. Stored models are reused
    unless `force` is set. `pad_to` adds generated commits up to that number; `explained` keeps that many explained
    samples. Message, author and date of the commit stay with a sample where the hunks have them. Samples are written next
    to the models once, so the syntax parse is not repeated for the vocabulary, the split, each fit and the evaluation.
    """
    spark = hunks.sparkSession
    if not force and M.models_exist(path, spark):
        models, vocabulary = M.load_models(path, spark)
        return {"status": "already_trained", "models": models, "vocabulary": vocabulary}
    if pad_to is not None:
        hunks = padded_hunks(hunks, hunks.select("commit_hash").distinct().count(), pad_to, pad_to)
    samples = labelled_features(hunks.withColumn("snippet_id", hunk_key(hunks))).select(
        "snippet_id", "commit_hash", *[c for c in METADATA if c in hunks.columns], "file_path", "code", "features",
        "quality_score", "is_high_quality", "issues", F.col("is_high_quality").cast("int").alias("label"))
    stratified_split(samples, ["snippet_id"]).write.mode("overwrite").parquet(f"{path}/samples")
    samples = spark.read.parquet(f"{path}/samples")
    if samples.isEmpty():
        return {"status": "no_features"}
    vocabulary = fit_vocabulary(samples)
    matrix = assemble(samples, vocabulary)
    models = M.train_baselines(matrix.where("split = 'train'"), ["snippet_id"], **model_options)
    M.save_models(models, vocabulary, path, spark)
    tested = matrix.where("split = 'test'")
    predictions = M.predict_all(models, tested, ["snippet_id"])
    metrics = classification_metrics(predictions, ["model"])
    result = {"status": "trained", "models": models, "vocabulary": vocabulary, "metrics": metrics,
              "predictions": predictions}
    if "random_forest" in models:
        importance = feature_importance(models["random_forest"], vocabulary, spark)
        result["importance"] = importance
        result["explanations"] = explain_samples(samples.where("split = 'test'"), importance, ["snippet_id"], explained)
    return result


def review(patches: DataFrame, models: dict | None = None, vocabulary: list[str] | None = None,
           answer: str | None = None, score: str | None = None, **parse) -> DataFrame:
    """Patches (commit_hash, patch) to reviewed hunks: one map-side pass, no shuffle.

    With trained models their flags are part of the comments. `answer` (a parsed external answer) and `score` (of a deep
    model) name columns of the patches, which every hunk of the patch carries.
    """
    return review_hunks(patch_hunks(patches, **parse), models, vocabulary, answer, score)


def review_hunks(hunks: DataFrame, models: dict | None = None, vocabulary: list[str] | None = None,
                 answer: str | None = None, score: str | None = None) -> DataFrame:
    """Add label, comments and the review struct to hunks; `answer` and `score` as in `review`."""
    if not models:
        return comprehensive_review(review_comments(with_review_inputs(hunks), score=score), answer)
    featured = with_feature_map(with_review_inputs(hunks, keep_nodes=True)).drop("nodes", "label_nodes", "label_status")
    scored = M.score_columns(assemble(featured, vocabulary), models).drop("vector", "features")
    return comprehensive_review(review_comments(scored, list(models), score), answer)


def review_table(patches: DataFrame, **options) -> DataFrame:
    """Review comments as rows, ready for the comment sink."""
    return comment_rows(review(patches, **options), ["commit_hash", "file_idx", "hunk_idx"])
