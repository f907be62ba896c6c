"""Training, review and streaming, end to end."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from diffscope.operators import hooks as H
from diffscope.operators import models as M
from diffscope.operators.diff import patch_hunks, snapshot_patch
from diffscope.operators.explain import linear_attributions, mean_absolute, permutation_importance
from diffscope.operators.features import assemble, feature_names, fit_vocabulary
from diffscope.operators.review import comprehensive_review, review_comments, with_review_inputs
from diffscope.plans import derive as V
from diffscope.plans import pipeline as PL
from diffscope.sources.tables import write_results
from diffscope.streaming.review_stream import review_stream, unseen

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def code_patches(spark):
    code = V.document_code(V.table(spark, SF, "documents")).where("doc_id < 120")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py"))
    return code.select(F.md5(F.col("doc_id").cast("string")).alias("commit_hash"),
                       snapshot_patch(path, F.lit("A"), F.col("code")).alias("patch"))


def test_train_store_and_review(spark, code_patches, tmp_path):
    path = str(tmp_path / "models")
    result = PL.train(patch_hunks(code_patches), path, models=("logistic", "random_forest", "svm"), trees=10, depth=4)
    assert result["status"] == "trained"
    metrics = {r.model: r for r in result["metrics"].collect()}
    assert set(metrics) == {"logistic", "random_forest", "svm"} and all(0 <= m.f1 <= 1 for m in metrics.values())
    assert result["importance"].count() == len(result["vocabulary"])
    first = result["explanations"].first()
    assert len(first.top_features) == 5 and len(first.code_snippet) <= 203
    again = PL.train(patch_hunks(code_patches), path)
    assert again["status"] == "already_trained" and again["vocabulary"] == result["vocabulary"]
    reviewed = PL.review(code_patches, again["models"], again["vocabulary"])
    assert reviewed.where(F.size("comments") == 0).count() == 0
    assert reviewed.count() == 120
    samples = spark.read.parquet(f"{path}/samples")
    assert sorted(r.split for r in samples.select("split").distinct().collect()) == ["test", "train"]
    matrix = assemble(samples, again["vocabulary"])
    assert feature_names(matrix) == again["vocabulary"] == fit_vocabulary(samples)
    attributions = linear_attributions(again["models"]["logistic"], matrix, ["snippet_id"], rows=10)
    assert mean_absolute(attributions).count() == len(again["vocabulary"])
    lost = permutation_importance(again["models"]["random_forest"], matrix, ["snippet_id"], again["vocabulary"])
    assert lost.count() == len(again["vocabulary"])
    write_results(result["metrics"], str(tmp_path / "results"))


def test_single_class_training_is_balanced(spark):
    rows = [(str(i), 1, {"a": float(i), "b": 1.0}) for i in range(40)]
    df = assemble(spark.createDataFrame(rows, "k string, label int, features map<string,double>"), ["a", "b"])
    models = M.train_baselines(df, ["k"], models=("logistic", "majority"))
    out = M.predict_all(models, df, ["k"]).where("model = 'majority'").first()
    assert (out.prediction, out.probability) == (1.0, 1.0)


def test_review_is_one_map_side_pass(spark, code_patches):
    stored = code_patches.limit(1)  # any source; the plan above it is what counts
    plan = PL.review_table(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_external_review(spark, code_patches):
    def factory():
        def client(prompt):
            if "def f6" in prompt:
                raise TimeoutError("slow")
            return '```json\n{"assessment": "fine"}\n```'
        return client

    hunks = H.with_prompt(with_review_inputs(patch_hunks(code_patches)))
    from diffscope.functions.review_text import parse_review
    answered = H.external_review(hunks, factory).withColumn("answer", parse_review(F.col("answer_text")))
    reviewed = comprehensive_review(review_comments(answered), "answer").select("review", "answer").collect()
    good = [r for r in reviewed if r.answer.error is None]
    assert good and all("AI Assessment: fine" in r.review.combined_feedback for r in good)
    failed = [r for r in reviewed if r.answer.error]
    assert failed and all(r.answer.error == "Request failed: slow" for r in failed)
    assert not any("AI Assessment" in line for r in failed for line in r.review.combined_feedback)


def test_score_batches(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "k int, code string")

    def make():
        import numpy as np
        return lambda codes: np.array([f"n{len(c)}" for c in codes], dtype=object)

    rows = H.score_batches(df, make, ["code"], "out", "string").collect()
    assert {r.k: r.out for r in rows} == {1: "n2", 2: "n4"}


def test_stream(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    os.mkdir(source)

    def put(name, commit, line):
        with open(f"{source}/{name}", "w") as f:
            f.write(f"From {commit} Mon Sep 17 00:00:00 2001\n\ndiff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n+{line}")

    put("1.patch", "a" * 40, "print(1)  # TODO")
    review_stream(spark, source, out, ckpt).awaitTermination(120)
    put("2.patch", "a" * 40, "print(1)  # TODO")  # reviewed before
    put("4.patch", "a" * 40, "x = 2")  # another patch of that commit
    put("3.patch", "b" * 40, "x = 3")
    review_stream(spark, source, out, ckpt).awaitTermination(120)
    put("5.patch", "a" * 40, "x = 2")  # reviewed before, in the second run
    shutil.rmtree(f"{ckpt}/commits")  # the last batch was not confirmed: it runs again
    review_stream(spark, source, out, ckpt).awaitTermination(120)
    rows = spark.read.parquet(f"{out}/comments").collect()
    of_a = [r.comment for r in rows if r.commit_hash == "a" * 40]
    assert "Added 1 new lines" in of_a and "Debug statements detected - remove before production" in of_a
    assert len([r for r in rows if r.commit_hash == "b" * 40 and r.comment_idx == 0]) == 1
    assert len([r for r in rows if r.commit_hash == "a" * 40 and r.comment_idx == 0]) == 2
    assert not os.path.exists(f"{out}/commits") and len(os.listdir(f"{ckpt}/state")) > 0
    plan = unseen(spark.readStream.text(source, wholetext=True).selectExpr("'c' AS commit_hash", "value AS patch"))
    assert plan.isStreaming and plan.columns == ["commit_hash", "patch"]
