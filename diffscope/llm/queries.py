"""Registered queries of this subpackage and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from diffscope.llm import decontaminate, fim, imatch, near_dedup, ngram_join, packing, quality, secrets, substring_dedup
from diffscope.llm import toxicity, training, warc, wavelet, whitening

# Batches that are exchanged with Python are bounded by bytes, as single texts can be very long.
RUNTIME_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
                "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op6_secret_scan(spark, folder):
    return secrets.digest(secrets.find_secrets(table(spark, folder, "documents")))


@query
def op2_ngram_join(spark, folder):
    return ngram_join.jaccard_join(table(spark, folder, "documents")).drop("root", "tag")


@query
def ngram_links(spark, folder):
    """op2_ngram_join with the number of links of each document, which that query's SQL does not have."""
    return ngram_join.jaccard_join(table(spark, folder, "documents"), links=True).drop("root", "tag")


@query
def op3_substring_dedup(spark, folder):
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


@query
def op5_decontaminate(spark, folder):
    return decontaminate.digest(decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query
def op1_warc(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op10_imatch(spark, folder):
    return imatch.edited_fingerprints(table(spark, folder, "documents"))


@query
def op7_toxicity(spark, folder):
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    return training.digest(toxicity.scores(documents, model), toxicity.OF, toxicity.HELD_OUT, toxicity.LEAST)


@query
def op9_quality(spark, folder):
    documents = table(spark, folder, "documents")
    model = quality.train(documents, table(spark, folder, "labels"))
    return training.digest(quality.scores(documents, model), quality.OF, quality.HELD_OUT, quality.LEAST)


@query
def op4_best_fit_packing(spark, folder):
    return packing.pack(packing.with_clusters(table(spark, folder, "documents")))


@query
def op8_token_ids(spark, folder):
    import public_tokenizers

    return wavelet.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_fill_in_middle(spark, folder):
    return fim.digests(fim.pieces(table(spark, folder, "documents")))


@query
def op12_near_duplicates(spark, folder):
    found = near_dedup.near_duplicates(table(spark, folder, "documents"), n=3, threshold=(85, 100),
                                       bands=near_dedup.BANDS, rows=near_dedup.ROWS)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op13_whitening(spark, folder):
    return whitening.table(table(spark, folder, "embeddings"))


SQL = {"op1_warc": warc.ORACLE_SQL, "op2_ngram_join": ngram_join.ORACLE_SQL, "ngram_links": ngram_join.LINKS_SQL, "op3_substring_dedup": substring_dedup.ORACLE_SQL,
       "op5_decontaminate": decontaminate.ORACLE_SQL, "op6_secret_scan": secrets.ORACLE_SQL,
       "op11_fill_in_middle": fim.ORACLE_SQL, "op12_near_duplicates": near_dedup.ORACLE_SQL}
