"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of their input; other columns of the input are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffscope.llm import decontaminate, ngram_join, packing, queries, secrets, toxicity
from diffscope.llm.store import written


def _plain(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the classifier learns from labelled ones outside its held-out fold."""
    queries.configure(spark)
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model, keep=tuple(docs.columns))
    return _plain(docs, scored.where(F.col("score") < toxicity.LEAST))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id (null last), of equal ids that of the least text hash.

    Documents without words are linked with nothing and stay.
    """
    queries.configure(spark)
    joined = ngram_join.jaccard_join(docs).select("doc_id", "tag", "root")
    first = joined.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("first")).select("first.doc_id", "first.tag")
    kept = first.unionByName(joined.where(F.col("root").isNull()).select("doc_id", "tag")).withColumnRenamed("doc_id", "_kept")
    # a null text has a hash as well (the seed), so it is met by equality
    same = docs["doc_id"].eqNullSafe(kept["_kept"]) & (F.xxhash64(docs["text"]) == kept["tag"])
    rows = docs.join(kept, same, "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])  # repeated rows are one document


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    queries.configure(spark)
    found = decontaminate.contamination(docs, queries.table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return _plain(docs, found.where("n_hit = 0"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; `n_chars` is counted anew where a text changed."""
    queries.configure(spark)
    found = secrets.find_secrets(docs).where(F.size("spans") > 0).dropDuplicates(["id", "blob"])
    blob = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    inside = docs.select(F.struct(*docs.columns).alias("d"), F.col("doc_id").alias("_id"), "text", blob.alias("_blob"))
    hit = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_blob") == F.col("blob"))
    joined = inside.join(found, hit, "left").select("d", "text", F.coalesce(
        "spans", F.expr("cast(array() as array<struct<start:int,number:int,kind:string,end:int>>)")).alias("spans"))
    clean = secrets.redact(joined)
    changed = ~F.col("text").eqNullSafe(F.col("d.text"))
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("d.n_chars"))}
    return clean.select(*[new.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    queries.configure(spark)
    return packing.pack(packing.with_lengths(docs.select("doc_id", "text", "source")))


STAGES = [("toxicity", drop_toxic), ("n-gram join", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # learned scores and packing are beyond SQL; tests/llm compares with a brute-force version
QUERIES = {"pipeline": run}
