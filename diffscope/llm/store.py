"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

FOLDER = "diffscope-llm"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when their statement has ended


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below `spark.checkpoint.dir`. Only where that is unset and the master is local a local folder is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="diffscope-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, FOLDER, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, computes once.

    The shuffles of that write are used by nothing else; their files are removed after it, not when the driver next
    collects garbage, so the disk in use is that of one step at a time.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


class Files:
    """Plain file operations for worker code on a shared folder: local mounts directly, other schemes by pyarrow."""

    def __init__(self, root: str):
        parsed = urlparse(root)
        if parsed.scheme in ("", "file"):
            from pyarrow.fs import LocalFileSystem

            self.fs, self.root = LocalFileSystem(), parsed.path
        else:
            from pyarrow.fs import FileSystem

            self.fs, self.root = FileSystem.from_uri(root)

    def path(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def make(self, name: str = "") -> None:
        self.fs.create_dir(self.path(name), recursive=True)

    def create(self, name: str):
        return self.fs.open_output_stream(self.path(name))

    def open(self, name: str):
        return self.fs.open_input_file(self.path(name))

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        with self.create(name) as f:
            f.write(data)

    def move(self, old: str, new: str) -> None:
        self.fs.move(self.path(old), self.path(new))

    def remove_folder(self, name: str) -> None:
        self.fs.delete_dir(self.path(name))

    def exists(self, name: str) -> bool:
        from pyarrow.fs import FileType

        return self.fs.get_file_info(self.path(name)).type != FileType.NotFound
