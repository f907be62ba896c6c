"""Classification metrics as DataFrames, for one or many models at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffscope.operators.distances import matched
from diffscope.operators.ordered import BOUND, order_key, running_total


CLASSIFICATION_TASKS = ("quality", "classification")
GENERATION_TASKS = ("comment", "refinement", "generation")


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def threshold(probability: Column, at: float = 0.5) -> Column:
    return (probability > F.lit(at)).cast("int")


def _by(by) -> list[str]:
    return list(by or [])


def rethresholded(df: DataFrame, by=None, label: str = "label", prediction: str = "prediction",
                  probability: str | None = "probability") -> DataFrame:
    """(by, label, prediction, n) counts; predictions of a model that only ever says one class are replaced by
    probability > 0.5. Counting comes first, so the check costs nothing on large inputs."""
    by = _by(by)
    if probability is None:
        return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
            F.count(F.lit(1)).alias("n"))
    counts = df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction"),
                        threshold(F.col(probability)).cast(df.schema[prediction].dataType).alias("_at_half")).agg(
        F.count(F.lit(1)).alias("n"))
    # the counts are a few rows per model, whatever the input
    kinds = F.size(F.collect_set("prediction").over(Window.partitionBy(*by)))
    chosen = F.when(F.col("_kinds") == 1, F.col("_at_half")).otherwise(F.col("prediction"))
    joined = counts.withColumn("_kinds", kinds)
    return joined.groupBy(*by, "label", chosen.alias("prediction")).agg(F.sum("n").alias("n"))


def confusion_matrix(df: DataFrame, by=None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(by, label, prediction, n): one row per cell that occurs."""
    return rethresholded(df, by, label, prediction, None)


def _per_class(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, support, predicted, hits) from confusion counts: a few rows."""
    cells = counts.select(*by, F.explode(F.array(
        F.struct(F.col("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").cast(counts.schema["label"].dataType).alias("label"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")))).alias("c"))
    return cells.groupBy(*by, F.col("c.label").alias("label")).agg(
        F.sum("c.support").alias("support"), F.sum("c.predicted").alias("predicted"), F.sum("c.hits").alias("hits"))


def _scores(per_class: DataFrame) -> DataFrame:
    precision = _zero(F.try_divide(F.col("hits"), F.col("predicted")))
    recall = _zero(F.try_divide(F.col("hits"), F.col("support")))
    return (per_class.withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1", _zero(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                 F.col("precision") + F.col("recall")))))


def classification_report(df: DataFrame, by=None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long report: one row per class plus `accuracy`, `macro avg` and `weighted avg`."""
    by = _by(by)
    scored = _scores(_per_class(confusion_matrix(df, by, label, prediction), by))
    rows = scored.select(*by, F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    weighted = [(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")]
    macro = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    accuracy = F.sum("hits") / total
    summaries = [
        scored.groupBy(*by).agg(*[accuracy.alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
        .withColumn("name", F.lit("accuracy")),
        scored.groupBy(*by).agg(*macro, total.alias("support")).withColumn("name", F.lit("macro avg")),
        scored.groupBy(*by).agg(*weighted, total.alias("support")).withColumn("name", F.lit("weighted avg")),
    ]
    return reduce(lambda a, b: a.unionByName(b), summaries, rows)


def roc_auc(df: DataFrame, by=None, label: str = "label", probability: str = "probability",
            bound: int = BOUND) -> DataFrame:
    """(by, roc_auc): exact area with ties averaged; 0 when the truth has one class.

    Rows are first counted per distinct score. The ranks come from running sums over prefixes of the scores' bits, of at
    most `bound` distinct scores each.
    """
    by = _by(by)
    positive = (F.col(label) == 1).cast("long")
    scores = df.groupBy(*by, F.col(probability).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    ranked = running_total(scores, by, order_key(scores, "score"), [], F.col("neg"), "neg_upto", bound)
    wins = F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") * 0.5)
    totals = ranked.groupBy(*by).agg(F.sum(wins).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    pairs = F.col("p").cast("double") * F.col("q").cast("double")
    return totals.select(*by, F.when(pairs > 0, F.col("wins") / pairs).otherwise(F.lit(0.0)).alias("roc_auc"))


def classification_metrics(df: DataFrame, by=None, label: str = "label", prediction: str = "prediction",
                           probability: str | None = "probability") -> DataFrame:
    """Accuracy, weighted precision, recall and F1 (0 where undefined) and, with probabilities, the exact AUC."""
    by = _by(by)
    scored = _scores(_per_class(rethresholded(df, by, label, prediction, probability), by))
    total = F.sum("support")
    metrics = scored.groupBy(*by).agg(
        (F.sum("hits") / total).alias("accuracy"),
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")])
    if probability is None:
        return metrics
    both = metrics.unionByName(roc_auc(df, by, label, probability), allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, with the total and whether there are at least two classes."""
    counts = _class_counts(df, label)
    return counts.select("label", "n", "total", (F.col("classes") >= 2).alias("has_both"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (classes * n_class) per class."""
    return _class_counts(df, label).select(
        "label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n, total, classes): the window runs over one row per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return counts.select("label", "n", F.sum("n").over(everything).alias("total"),
                         F.count(F.lit(1)).over(everything).alias("classes"))


def positive_share(df: DataFrame, label: str = "is_high_quality") -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("int")).alias("positive_share"))


def evaluate_tasks(df: DataFrame, task_col: str = "task", key: list[str] | None = None, **text_options) -> DataFrame:
    """(task, metric, value) for all tasks of a table at once.

    Rows of classification tasks carry label, prediction and probability, those of generation tasks generated, reference
    and `key`; the other columns of a row are null. Tasks of any other name are an error. `text_options` go to
    `generation_metrics`.
    """
    from diffscope.operators.text_metrics import generation_metrics

    task = F.col(task_col)
    known = F.when(task.isin(*CLASSIFICATION_TASKS, *GENERATION_TASKS), task).otherwise(
        F.raise_error(F.concat(F.lit("unknown task "), F.coalesce(task, F.lit("null")))))
    df = df.withColumn(task_col, known)

    def long(metrics: DataFrame) -> DataFrame:
        names = [c for c in metrics.columns if c != task_col]
        return metrics.select(F.col(task_col).alias("task"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select(
            "task", "m.*")

    out = long(classification_metrics(df.where(F.col(task_col).isin(*CLASSIFICATION_TASKS)), [task_col]))
    if key:
        texts = df.where(F.col(task_col).isin(*GENERATION_TASKS))
        out = out.unionByName(long(generation_metrics(texts, key, by=[task_col], **text_options)))
    return out


def evaluate(df: DataFrame, task: str, **kwargs) -> DataFrame:
    """Metrics for a task name: classification for quality/classification, text metrics for the generation tasks."""
    from diffscope.operators.text_metrics import generation_metrics

    if task in CLASSIFICATION_TASKS:
        return classification_metrics(df, **kwargs)
    if task in GENERATION_TASKS:
        return generation_metrics(df, **kwargs)
    raise ValueError(f"unknown task {task!r}")
