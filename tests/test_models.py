"""The kernel machine against an exact one, pooling against plain sums."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from diffscope.operators import models as M
from diffscope.operators import pooling as P


def exact_machine(k, y, cost, steps=60_000):
    """Dual of the soft-margin machine with an intercept, by the most violating pair of coordinates."""
    n = len(y)
    alpha, gradient = np.zeros(n), -np.ones(n)
    for _ in range(steps):
        up = ((y > 0) & (alpha < cost - 1e-12)) | ((y < 0) & (alpha > 1e-12))
        low = ((y < 0) & (alpha < cost - 1e-12)) | ((y > 0) & (alpha > 1e-12))
        score = -y * gradient
        i, j = np.argmax(np.where(up, score, -np.inf)), np.argmin(np.where(low, score, np.inf))
        if score[i] - score[j] < 1e-5:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (score[i] - score[j]) / curve
        step = min(step, cost[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost[j] - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        gradient += step * y * (k[:, i] - k[:, j])
    score = -y * gradient
    free = (alpha > 1e-8) & (alpha < cost - 1e-8)
    bias = score[free].mean() if free.any() else (score[i] + score[j]) / 2
    return k @ (alpha * y) + bias


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) * [1, 10, 0.1, 3] + [0, 5, 0, -2]
    y = ((x[:, 0] * x[:, 3] + 0.3 * rng.normal(size=500)) > -1).astype(float)
    data = [(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "k int, label double, v array<double>").withColumn("vector", array_to_vector("v"))
    return M.with_class_weight(df).select("k", "label", "weight", "vector").cache()


def test_decision_values_are_those_of_an_exact_kernel_machine(spark, rows):
    model = M.fit_svm(rows, ["k"], 4, size=500, iterations=300, folds=2)
    scored = model.transform(rows).select(
        "label", "weight", vector_to_array("scaled").alias("x"), vector_to_array("margin")[1].alias("m"),
        vector_to_array("probability_vector")[1].alias("p")).collect()
    x, y = np.array([r.x for r in scored]), np.array([2 * r.label - 1 for r in scored])
    exact = exact_machine(M.gaussian(x, x, 0.25), y, np.array([r.weight for r in scored]))
    ours = np.array([r.m for r in scored])
    assert np.abs(ours - exact).mean() < 0.05 and np.corrcoef(ours, exact)[0, 1] > 0.995
    assert ((ours > 0) == (exact > 0)).mean() > 0.98
    p = np.array([r.p for r in scored])
    assert (np.diff(p[np.argsort(ours)]) >= -1e-12).all() and ((p > 0.5) == (y > 0)).mean() > 0.85


def test_few_landmarks_and_folds_without_a_label(spark, rows, tmp_path):
    model = M.fit_svm(rows, ["k"], 4, size=40, iterations=40, folds=3)
    assert model.stages[1].getOrDefault("size") == 40
    M.save_models({"svm": model}, ["a"], str(tmp_path / "m"), spark)
    loaded = M.load_models(str(tmp_path / "m"), spark)[0]
    both = [M.predict_all(m, rows, ["k"]).orderBy("k").collect() for m in ({"svm": model}, loaded)]
    assert both[0] == both[1]
    accuracy = np.mean([r.prediction == r.label for r in both[0]])
    assert accuracy > 0.8
    few = rows.where("label = 0").unionByName(rows.where("label = 1").limit(1))
    with pytest.raises(ValueError):
        M.fit_svm(few, ["k"], 4)


@pytest.mark.parametrize("scale", [1, 400])
def test_pooling_of_far_scores_and_null_bags(spark, scale):
    rng = np.random.default_rng(scale)
    data = [(b, i, float(rng.normal() * scale) if (i + len(b or "")) % 7 else None, [float(v) for v in rng.normal(size=3)])
            for b in ("x", "yy", None) for i in range(40)] + [("none", 0, None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(data, "bag string, i int, s double, v array<double>").repartition(3)
    weights = {(r.bag, r.i): r.attention_weight for r in P.attention_weights(df, "bag", "s").collect()}
    pooled = {r.bag: r for r in P.attention_pool(df, "bag", "v", "s").collect()}
    assert len(weights) == len(data) and set(pooled) == {"x", "yy", None, "none"}
    for bag in pooled:
        mine = [r for r in data if r[0] == bag]
        known = [r for r in mine if r[2] is not None]
        assert pooled[bag].instances == len(mine)
        if not known:
            assert pooled[bag].pooled is None and weights[bag, 0] is None
            continue
        top = max(r[2] for r in known)
        e = [math.exp(r[2] - top) for r in known]
        assert [weights[bag, r[1]] for r in known] == pytest.approx([v / sum(e) for v in e])
        assert pooled[bag].pooled == pytest.approx(np.average([r[3] for r in known], axis=0, weights=e))
        assert all(weights[bag, r[1]] is None for r in mine if r[2] is None)
    plan = P.attention_pool(df, "bag", "v", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_calibration_reads_margins_once(spark, monkeypatch):
    plans, fit = [], M.LogisticRegression.fit

    def noted(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, df)

    monkeypatch.setattr(M.LogisticRegression, "fit", noted)
    rows = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("weight"),
                                  array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 2) * 1.0)).alias("vector"))
    M.fit_svm(rows, ["k"], 2, iterations=2)
    assert len(plans) == 1 and "Union" not in plans[0]
