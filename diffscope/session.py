"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are designed for. The parse step can return many node rows per snippet, so Arrow
# batches are kept small; adaptive execution sizes shuffles and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


# Name of a setting: partitions to deal each test table to. Unset by default; large tables need none.
READ_PARTITIONS = "diffscope.read.partitions"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "diffscope", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session. Cluster sizing such as shuffle partitions is left to the caller's configuration."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only where nothing is set and the master is local (tests on one machine) a temporary folder is used; on a cluster the
    setting is required.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="diffscope-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back: computed once, lineage cut, columns prunable."""
    path = posixpath.join(shared_folder(df.sparkSession), "diffscope", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
