"""The edited fingerprints shuffle the texts once."""

from pyspark.sql import functions as F

from diffscope.llm import imatch


def test_texts_are_not_shuffled_to_find_heads(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of row "), "id").alias("text"))
    found = imatch.edited_fingerprints(rows, shard_bytes=500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(r.doc_id for r in found.collect()) == list(range(200))
