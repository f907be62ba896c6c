"""Continuous review of incoming patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diffscope.plans.pipeline import review_table
from diffscope.sources.patches import patch_identity


def patch_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of patches from a folder that receives one patch per file."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return files.select(patch_identity(F.col("value"), F.col("file")).alias("commit_hash"),
                        F.col("value").alias("patch"))


def unseen(patches: DataFrame, remember: str = "30 days") -> DataFrame:
    """Patches whose commit and text did not come within the time before, by keys in the stream's state store.

    The time is that of arrival (the batch's clock, which a replayed batch keeps), so no patch is ever too late. A key
    leaves the state when its time is over, which bounds the state by the patches of that time.
    """
    return (patches.withColumns({"digest": F.sha2("patch", 256), "seen_at": F.current_timestamp()})
            .withWatermark("seen_at", remember).dropDuplicatesWithinWatermark(["commit_hash", "digest"])
            .drop("digest", "seen_at"))


def review_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, available_now: bool = True,
                  max_files: int | None = None, remember: str = "30 days", **options) -> StreamingQuery:
    """Review every new patch once and write its comments below `output`.

    A patch is known by its commit and its text for the time `remember`; another patch of the same commit is reviewed.
    Each micro-batch owns the folder batch_id=<n> and overwrites it when it is replayed, so a restart neither loses nor
    repeats comments. Nothing that earlier batches wrote is read again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        review_table(batch, **options).write.mode("overwrite").parquet(f"{output}/comments/batch_id={batch_id}")

    writer = (unseen(patch_stream(spark, folder, max_files), remember).writeStream.foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
