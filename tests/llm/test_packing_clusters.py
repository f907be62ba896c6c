"""Clusters of the packing query: whole tables, clashing names, empty texts, and the exact join beside the sketch."""

from collections import defaultdict

from pyspark.sql import functions as F

from diffscope.llm import ngram_join, packing, queries
from tests.llm import cases


def groups(df):
    found = defaultdict(list)
    for r in df.where("length > 0").select("cluster", "doc_id", "length").collect():
        found[r.cluster].append((repr(r.doc_id), r.length))
    return sorted(sorted(g) for g in found.values())


def test_clusters_are_those_of_the_exact_join(spark):
    queries.configure(spark)
    docs = cases.table(spark, cases.documents(copies=40))
    assert groups(packing.with_clusters(docs)) == groups(packing.with_clusters(docs, find=ngram_join.jaccard_join))


def test_clashing_names(spark):
    docs = cases.table(spark, cases.documents(copies=5)).select(
        "doc_id", "text", "source", *[F.lit(1).alias(c) for c in ("root", "_id", "_tag", "tag", "f", "d", "n_shingles")])
    found = packing.with_clusters(docs)
    assert found.columns == [*[c for c in docs.columns if c != "text"], "length", "cluster"]
    assert packing.pack(found).where("piece = 0").count() == docs.count()


def test_empty_texts_are_dealt_to_no_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("s").alias("source"))
    found = packing.pack(packing.with_lengths(docs))
    assert found.where("bin_id IS NULL AND length = 0 AND piece = 0").count() == 3000
    assert "length#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Union" in plan

