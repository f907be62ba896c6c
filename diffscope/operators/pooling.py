"""Attention pooling of instance vectors into bags.

Scores are grouped in steps of `STEP` below which exponentials cannot overflow; each (bag, step) has a partial sum, combined
in tasks before the shuffle, and the few steps of a bag are put together relative to its highest one. So the softmax is
stable, the input is read once, and a bag with very many instances is no single task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attention_scores(vec: Column, hidden: np.ndarray, output: np.ndarray) -> Column:
    """output . tanh(hidden . x) for each instance, with given weights (hidden x dim, hidden)."""
    hidden, output = np.asarray(hidden, dtype="float64"), np.asarray(output, dtype="float64")

    def score(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], type=pa.float64())
        x = np.asarray(batch.flatten(), dtype="float64").reshape(len(batch), -1)
        return pa.array(np.tanh(x @ hidden.T) @ output, type=pa.float64())

    return F.arrow_udf(score, "double")(vec)


STEP = 32.0  # exp(32) times any number of rows is far from the end of doubles


def _steps(score: str) -> tuple[Column, Column]:
    """Number of a score's step, and the exponential of its height above the step."""
    step = F.floor(F.col(score) / STEP)
    return step, F.exp(F.col(score) - step * STEP)


def _bag_sums(df: DataFrame, bag: str, score: str) -> DataFrame:
    """(bag, _top, _sum): highest step of each bag, and the sum of exp(score - _top * STEP)."""
    step, height = _steps(score)
    parts = df.where(F.col(score).isNotNull()).groupBy(bag, step.alias("_step")).agg(F.sum(height).alias("_part"))
    tops = F.max("_step")
    listed = parts.groupBy(bag).agg(tops.alias("_top"), F.collect_list(F.struct("_step", "_part")).alias("_parts"))  # few per bag
    return listed.select(bag, "_top", F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["_part"] * F.exp(
        (p["_step"] - F.col("_top")) * STEP)).alias("_sum"))


def attention_weights(df: DataFrame, bag: str, score: str, output: str = "attention_weight") -> DataFrame:
    """Add the softmax of `score` within each bag (null is a bag). A null score has a null weight and counts for nothing."""
    sums = _bag_sums(df, bag, score).withColumnRenamed(bag, "_bag")
    joined = df.join(sums, df[bag].eqNullSafe(sums["_bag"]), "left")
    return joined.withColumn(output, F.exp(F.col(score) - F.col("_top") * STEP) / F.col("_sum")).drop("_bag", "_top", "_sum")


def attention_pool(df: DataFrame, bag: str, vec: str, score: str) -> DataFrame:
    """(bag, instances, pooled ARRAY<DOUBLE>): attention-weighted mean vector of each bag.

    Instances without a score are counted, but have no weight; a bag without any score has a null vector.
    """
    step, height = _steps(score)
    known = F.col(score).isNotNull()
    # rows without a score are a step of their own, whose mean is not used: any vector will do there
    rows = df.select(bag, step.alias("_step"), F.coalesce(height, F.lit(1.0)).alias("_w"), array_to_vector(
        F.when(known, F.col(vec).cast("array<double>")).otherwise(F.array(F.lit(0.0)))).alias("_v"))
    parts = rows.groupBy(bag, "_step").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_part"), Summarizer.mean(F.col("_v"), F.col("_w")).alias("_mean"))
    counts = parts.groupBy(bag).agg(F.sum("_n").alias("instances"), F.max("_step").alias("_top"), F.collect_list(F.when(
        F.col("_step").isNotNull(), F.struct("_step", "_part", vector_to_array("_mean").alias("mean")))).alias("_parts"))
    weighted = F.transform("_parts", lambda p: F.struct((p["_part"] * F.exp((p["_step"] - F.col("_top")) * STEP)).alias("w"),
                                                        p["mean"].alias("mean")))
    total = F.aggregate("_weighted", F.lit(0.0), lambda acc, p: acc + p["w"])
    first = F.transform(F.element_at("_weighted", 1)["mean"], lambda x: F.lit(0.0))
    summed = F.aggregate("_weighted", first, lambda acc, p: F.zip_with(acc, p["mean"], lambda x, y: x + y * p["w"]))
    pooled = F.when(F.size("_weighted") > 0, F.transform(summed, lambda x: x / F.col("_total")))
    return counts.withColumn("_weighted", weighted).withColumn("_total", total).select(bag, "instances", pooled.alias("pooled"))


def _dot(vec: Column, weights: list[float], bias: float) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vec, w, lambda a, b: a * b), F.lit(float(bias)), lambda acc, x: acc + x)


def bag_prediction(pooled: DataFrame, weights: list[float], bias: float = 0.0, vec: str = "pooled",
                   output: str = "probability", hidden: list[list[float]] | None = None,
                   hidden_bias: list[float] | None = None) -> DataFrame:
    """Sigmoid of a head over the pooled vector; with `hidden` weights the head has a layer of rectified units."""
    inner = F.col(vec)
    if hidden is not None:
        biases = hidden_bias or [0.0] * len(hidden)
        inner = F.array(*[F.greatest(F.lit(0.0), _dot(inner, w, b)) for w, b in zip(hidden, biases)])
    return pooled.withColumn(output, 1 / (1 + F.exp(-_dot(inner, weights, bias))))


def attention_report(weighted: DataFrame, on: list[str]) -> DataFrame:
    """Attention per hunk with its file and change size, ready for a CSV sink, from hunks with their `attention_weight`."""
    rows = weighted if "lines_added" in weighted.columns else with_line_counts(weighted)
    return rows.select(*on, "attention_weight", "file_path", "lines_added", "lines_removed")


def with_line_counts(hunks: DataFrame) -> DataFrame:
    return hunks.withColumns({"lines_added": F.size("added_lines"), "lines_removed": F.size("removed_lines")})
