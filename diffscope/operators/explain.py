"""Explanations as tables: importances, attributions of linear models and forests, permutation importance, per-sample summaries."""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffscope.functions.text import let, preview
from diffscope.operators.features import feature_names
from diffscope.operators.sampling import hash_sample, key_digest
from diffscope.session import shared_folder, written


def _last_with(model, attribute: str):
    stages = getattr(model, "stages", [model])
    return next((s for s in reversed(stages) if hasattr(s, attribute)), None)


def feature_importance(model, names: list[str], spark: SparkSession, k: int | None = None) -> DataFrame:
    """(feature, importance) of a tree model, largest first, ties by name; absolute coefficients for a linear one."""
    tree = _last_with(model, "featureImportances")
    if tree is not None:
        values = tree.featureImportances.toArray().tolist()
    else:
        linear = _last_with(model, "coefficients")
        if linear is None:
            raise ValueError("model has neither importances nor coefficients")
        values = [abs(v) for v in linear.coefficients.toArray().tolist()]
    table = spark.createDataFrame(list(zip(names, map(float, values))), "feature string, importance double")
    table = table.orderBy(F.desc("importance"), "feature")
    return table.limit(k) if k else table


def linear_attributions(model, df: DataFrame, key: list[str], features: str = "scaled", rows: int | None = None,
                        seed: int = 42) -> DataFrame:
    """(key, feature, attribution): coefficient * (x - mean x) of a linear model on its own (scaled) inputs.

    `rows` keeps a random sample, as a top-n over key digests; by default every row is explained.
    """
    linear = _last_with(model, "coefficients")
    names = feature_names(df, "vector")
    vectors = model.transform(df).select(*key, features)
    means = vectors.agg(vector_to_array(Summarizer.mean(F.col(features))))  # one number per feature
    scored = vectors.select(*key, vector_to_array(features).alias("x"))
    if rows:
        scored = hash_sample(scored, key, rows, seed)
    weights = F.array(*[F.lit(float(c)) for c in linear.coefficients.toArray()])
    shifted = F.zip_with(F.zip_with("x", "_m", lambda x, m: x - m), weights, lambda d, w: d * w)
    return (scored.withColumn("_m", means.scalar())
            .select(*key, F.posexplode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"),
                                                    shifted.alias("attribution"))).alias("i", "a"))
            .select(*key, "a.feature", "a.attribution"))


def mean_absolute(attributions: DataFrame) -> DataFrame:
    """(feature, mean_abs) over all explained rows."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


GROUP_ROWS = 1000


def permutation_importance(model, df: DataFrame, key: list[str], vocabulary: list[str], label: str = "label",
                           features: str = "vector", seed: int = 42) -> DataFrame:
    """(feature, importance): loss of accuracy when one feature takes the value of another random row.

    Rows are dealt at random to groups of about a thousand and take the value of the next row of their group in a random
    order (the last that of the first). A row goes through the model once per feature, one vector at a time: a pass over
    the rows with their partner's vector for each feature, all in one query.
    """
    base = df.select(*key, F.col(label).cast("double").alias("label"), vector_to_array(features).alias("x"),
                     key_digest(key, seed).alias("_digest"))
    groups = max(1, df.count() // GROUP_ROWS)
    group = Window.partitionBy("_group").orderBy("_digest")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = written(base.withColumn("_group", F.pmod(F.xxhash64("_digest"), F.lit(groups))).select(
        "label", "x", F.coalesce(F.lead("x").over(group), F.first("x").over(whole)).alias("y")))
    metadata = df.schema[features].metadata

    def accuracy(feature: int) -> DataFrame:
        x = F.col("x") if feature < 0 else F.transform("x", lambda v, j: F.when(
            j == feature, F.element_at("y", feature + 1)).otherwise(v))
        # always true, but not deterministic: keeps the vector a column of its own (see features.assemble)
        x = F.when(F.monotonically_increasing_id() >= 0, x)
        trial = paired.select("label", array_to_vector(x).alias(features)).withMetadata(features, metadata)
        return model.transform(trial).agg(F.avg((F.col("model_prediction") == F.col("label")).cast("double")).alias("a")).select(
            F.lit(feature).alias("i"), "a")

    found = reduce(DataFrame.unionByName, [accuracy(i) for i in range(-1, len(vocabulary))])  # one row per feature
    names = F.array(*[F.lit(n) for n in vocabulary])
    spread = found.agg(F.max(F.when(F.col("i") < 0, F.col("a"))).alias("whole"), F.collect_list(F.struct("i", "a")).alias("all"))
    return (spread.select("whole", F.explode("all").alias("a")).where("a.i >= 0")
            .select(F.element_at(names, F.col("a.i") + 1).alias("feature"), (F.col("whole") - F.col("a.a")).alias("importance")))


def explain_samples(df: DataFrame, importance: DataFrame, key: list[str], n: int | None = None, top: int = 5,
                    seed: int = 42) -> DataFrame:
    """Per sample: code preview, label, score, issues and the model's top features with the sample's values."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(top).agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature"))), lambda s: s["feature"]))
    rows = hash_sample(df, key, n, seed) if n else df
    return (rows.withColumn("_top", best.scalar()).select(
        *key, preview(F.col("code")).alias("code_snippet"), F.col("is_high_quality").alias("predicted_quality"),
        "quality_score", F.col("issues").alias("key_issues"),
        let(F.col("features"), lambda features: F.transform("_top", lambda name: F.struct(
            name.alias("feature"), F.coalesce(F.try_element_at(features, name), F.lit(0.0)).alias("value"))))
        .alias("top_features")))


# ------------------------------------------------------------------ forests

QUADRATURE_EXACT = 2  # a rule of q points is exact for polynomials of degree 2q - 1


@dataclass
class Leaves:
    """Leaves of a forest as flat arrays, one row per leaf and one column per feature on its path.

    A leaf is reached by rows with low < x <= high for each of its features; `share` is the part of the training weight
    that goes the leaf's way at the splits on that feature. Unused columns have feature 0, share 1 and no bounds.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray  # the leaf's part of the forest's probability of class 1


def forest_leaves(model, spark: SparkSession) -> tuple[Leaves, float]:
    """Leaves of a fitted random forest of numeric features, and its base value, the expected probability.

    The trees are read from the model's own saved tables; they are as large as the model, whatever the data.
    """
    forest = _last_with(model, "trees")
    folder = posixpath.join(shared_folder(spark), "diffscope", uuid.uuid4().hex)
    forest.write().save(folder)
    rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    paths, values = [], []
    for nodes in trees.values():
        ahead = [(0, {})]
        while ahead:
            at, path = ahead.pop()
            node = nodes[at]
            weight = sum(node["impurityStats"])
            if node["leftChild"] < 0:
                paths.append(path)
                values.append(node["impurityStats"][1] / weight / len(trees))
                continue
            split = node["split"]
            if split["numCategories"] >= 0:
                raise ValueError("attributions need numeric features")
            name, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, share = path.get(name, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                part = sum(nodes[child]["impurityStats"]) / weight
                ahead.append((child, {**path, name: (*bounds, share * part)}))
    width = max(1, max(map(len, paths), default=1))
    shape = (len(paths), width)
    leaves = Leaves(np.zeros(shape, dtype=np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape),
                    np.array(values))
    for i, path in enumerate(paths):
        for j, (name, (low, high, share)) in enumerate(path.items()):
            leaves.feature[i, j], leaves.low[i, j], leaves.high[i, j], leaves.share[i, j] = name, low, high, share
    return leaves, float(leaves.value @ leaves.share.prod(axis=1))


def leaf_attributions(leaves: Leaves, x: np.ndarray, width: int) -> np.ndarray:
    """Additive attributions (one row per row of x, one column per feature).

    In a coalition that holds each other feature with odds t, a leaf of value v counts v * prod(o t + z (1 - t)), where o
    says whether the row goes the leaf's way and z is the share that does. The Shapley weights of a feature are the
    integral of that product over t from 0 to 1 without the feature's own factor, times (o - z). The product is a
    polynomial of t, so Gauss-Legendre points integrate it exactly, and one product serves all features of a leaf. Leaves
    with as many features on their path go together, so that short paths cost no unused columns and fewer points.
    """
    bounded = np.isfinite(leaves.low) | np.isfinite(leaves.high)
    used, packed = bounded.sum(axis=1), np.argsort(~bounded, axis=1, kind="stable")
    out = np.zeros((len(x), width))
    for n in np.unique(used[used > 0]):  # a leaf without a split tells no feature from another
        some = np.flatnonzero(used == n)
        at = packed[some, :n]
        out += _of_equal_paths(Leaves(*[np.take_along_axis(part[some], at, axis=1) for part in (
            leaves.feature, leaves.low, leaves.high, leaves.share)], leaves.value[some]), x, width)
    return out


def _of_equal_paths(leaves: Leaves, x: np.ndarray, width: int) -> np.ndarray:
    """`leaf_attributions` of leaves that use all of their columns."""
    points = leaves.feature.shape[1] // QUADRATURE_EXACT + 1
    t, weight = np.polynomial.legendre.leggauss(points)
    t, weight = (t + 1) / 2, weight / 2
    out = np.zeros((len(x), width))
    step = max(1, (1 << 22) // max(1, leaves.feature.size))
    flat = leaves.feature.ravel()
    order = np.argsort(flat, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) > 0)))
    for low in range(0, len(x), step):
        some = x[low:low + step]
        at = some[:, leaves.feature]  # rows x leaves x features of the path
        ours = ((at > leaves.low) & (at <= leaves.high)).astype(np.float64)
        total = np.zeros_like(ours)
        for ti, wi in zip(t, weight):
            factor = ours * ti + leaves.share * (1 - ti)
            total += (wi * leaves.value * factor.prod(axis=2))[:, :, None] / factor
        part = (total * (ours - leaves.share)).reshape(len(some), -1)
        out[low:low + step, flat[order][heads]] = np.add.reduceat(part[:, order], heads, axis=1)
    return out


def forest_attributions(model, df: DataFrame, key: list[str], features: str = "vector") -> DataFrame:
    """(key, base, attributions): additive attributions of a random forest's probability of class 1, for every row.

    `attributions` has one number per feature; base and attributions add up to the probability. Expectations over absent
    features follow the training weights along the tree's paths. A null vector has null attributions.
    """
    leaves, base = forest_leaves(model, df.sparkSession)
    width = _last_with(model, "trees").numFeatures

    def explain(batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        offsets = np.arange(len(batch) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaf_attributions(leaves, x, width).reshape(-1)))

    def part(rows: DataFrame, values: Column) -> DataFrame:
        return rows.select(*key, F.lit(base).alias("base"), values.alias("attributions"))

    given = F.col(features).isNotNull()  # vector_to_array takes no nulls
    return part(df.where(given), F.arrow_udf(explain, "array<double>")(vector_to_array(features))).unionByName(
        part(df.where(~given), F.lit(None).cast("array<double>")))
