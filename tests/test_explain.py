"""Attributions of forests against all subsets of features."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from diffscope.operators import explain as XP

WIDTH = 6


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, WIDTH)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=400)) > 0).astype(float)
    rows = [(i, float(v), [float(a) for a in r], 1.0 + (i % 3)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k int, label double, v array<double>, weight double").withColumn("vector", array_to_vector("v"))
    model = Pipeline(stages=[RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=7, maxDepth=6, seed=3,
        probabilityCol="probability_vector", predictionCol="model_prediction")]).fit(df)
    return df, model, x


def expectation(leaves, row, known):
    """Value of the forest where only the features of `known` are given."""
    total = 0.0
    for f, low, high, share, value in zip(leaves.feature, leaves.low, leaves.high, leaves.share, leaves.value):
        for j in range(len(f)):
            bounded = np.isfinite(low[j]) or np.isfinite(high[j]) or share[j] != 1
            if bounded:
                value = value * (float(low[j] < row[f[j]] <= high[j]) if f[j] in known else share[j])
        total += value
    return total


def test_attributions_are_shapley_values(spark, fitted):
    df, model, x = fitted
    leaves, base = XP.forest_leaves(model, spark)
    found = XP.leaf_attributions(leaves, x[:5], WIDTH)
    for row, ours in zip(x[:5], found):
        values = {s: expectation(leaves, row, s) for n in range(WIDTH + 1) for s in combinations(range(WIDTH), n)}
        assert values[()] == pytest.approx(base)
        for f in range(WIDTH):
            exact = sum(math.factorial(len(s)) * math.factorial(WIDTH - len(s) - 1) / math.factorial(WIDTH)
                        * (values[tuple(sorted((*s, f)))] - values[s])
                        for n in range(WIDTH) for s in combinations([g for g in range(WIDTH) if g != f], n))
            assert ours[f] == pytest.approx(exact, abs=1e-12)


def test_attributions_add_up_to_the_probability(spark, fitted):
    df, model, _ = fitted
    more = df.unionByName(df.limit(2).withColumn("vector", F.lit(None).cast(df.schema["vector"].dataType)).withColumn("k", F.col("k") + 1000))
    found = {r.k: r for r in XP.forest_attributions(model, more, ["k"]).collect()}
    assert len(found) == 402 and sum(r.attributions is None for r in found.values()) == 2
    for r in model.transform(df).select("k", "probability_vector").collect():
        assert found[r.k].base + sum(found[r.k].attributions) == pytest.approx(r.probability_vector[1], abs=1e-12)


def test_nominal_features_are_refused(spark):
    class Model:
        trees = []

    with pytest.raises(AttributeError):
        XP.forest_leaves(Model(), spark)


def test_short_paths_take_few_points(monkeypatch):
    inf, points, rule = np.inf, [], np.polynomial.legendre.leggauss
    monkeypatch.setattr(np.polynomial.legendre, "leggauss", lambda n: points.append(n) or rule(n))
    feature = np.array([[0, 0, 0, 0], [0, 1, 2, 3]])
    low = np.array([[0.5, -inf, -inf, -inf], [0.5, 0.5, 0.5, 0.5]])
    share = np.array([[0.25, 1, 1, 1], [0.5, 0.5, 0.5, 0.5]])
    leaves = XP.Leaves(feature, low, np.full((2, 4), inf), share, np.array([1.0, 1.0]))
    got = XP.leaf_attributions(leaves, np.ones((1, 4)), 4)
    even = (1 - 0.5 ** 4) / 4
    assert got[0] == pytest.approx([0.75 + even, even, even, even])
    assert points == [1, 3]
