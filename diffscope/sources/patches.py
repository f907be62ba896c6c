"""Patch sources: `git log -p` dumps, one-patch-per-file folders, diff columns, whole files, commit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffscope.operators.carried import carried
from diffscope.operators.ordered import running_total

# What is known of a commit besides its patch.
METADATA = ("message", "author", "committed_at", "committed_date")
LOG_HEADER = r"^(?:commit )?([0-9a-f]{40})"


def _field(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def _log_columns(record: Column) -> dict[str, Column]:
    """Columns of one commit of `git log -p --date=iso-strict --parents`."""
    head = F.element_at(F.split(record, r"\n(?=diff --git a/)", 2), 1)
    body = F.element_at(F.split(head, r"\n\n", 2), 2)
    message = F.array_join(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, F.lit("^    "), F.lit(""))), "\n")
    parents = F.regexp_extract_all(F.substring_index(record, "\n", 1), F.lit(r"([0-9a-f]{40})"), F.lit(1))
    at = F.instr(record, "\ndiff --git a/")
    return {
        "commit_hash": F.regexp_extract(record, LOG_HEADER, 1),
        "message": F.regexp_replace(message, F.lit(r"\s+$"), F.lit("")),
        "author": _field(head, r"(?m)^Author:\s+(.*?)(?:\s+<[^>]*>)?$"),
        "committed_at": F.try_to_timestamp(_field(head, r"(?m)^(?:Commit)?Date:\s+(\S+)$")),
        "committed_date": _field(head, r"(?m)^(?:Commit)?Date:\s+(\S+)$"),
        "parent_hash": F.try_element_at(parents, F.lit(2)),
        "is_merge": F.coalesce(head.rlike(r"(?m)^Merge: "), F.lit(False)) | (F.size(parents) > 2),
        "patch": F.when(at > 0, F.expr("substring(value, instr(value, '\\ndiff --git a/') + 1)")).otherwise(F.lit("")),
    }


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits with their patch from `git log -p` text (newest first).

    The text is cut at lines that begin with `commit `: message lines are indented and diff lines are prefixed, so only
    commit headers match. The cut is the reader's record separator, which keeps large dumps splittable.
    """
    records = spark.read.option("lineSep", "\ncommit ").text(path).where("length(value) > 0")
    columns = _log_columns(F.col("value"))
    return records.select(*[c.alias(n) for n, c in columns.items()]).where("commit_hash <> ''")


def read_patch_files(spark: SparkSession, path: str) -> DataFrame:
    """One patch per file (format-patch or saved diffs): commit_hash and patch.

    The commit hash comes from a mail header when there is one, else from the file's path.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return files.select(patch_identity(F.col("value"), F.col("file")).alias("commit_hash"),
                        F.col("value").alias("patch"))


def patch_identity(text: Column, fallback: Column) -> Column:
    found = F.regexp_extract(text, r"^(?:From|commit) ([0-9a-f]{40})", 1)
    return F.when(found != "", found).otherwise(F.md5(fallback))


def read_patches(spark: SparkSession, path: str, layout: str = "log", limit: int | None = None,
                 metadata: bool = False) -> tuple:
    """(commits, patches). `limit` keeps the newest commits. Merges and parentless commits have no patch.

    With `metadata` each patch carries message, author and date of its commit, which hunks and training samples made of
    it keep: nothing has to be joined later.
    """
    if layout == "files":
        if limit is not None:
            raise ValueError("files have no order, so they cannot be limited to the newest")
        patches = read_patch_files(spark, path)
        return None, patches
    found = read_log(spark, path)
    if limit:
        found = newest(found, limit)
    commits = found.drop("patch")
    patches = found.where(has_patch()).select("commit_hash", *(METADATA if metadata else ()), "patch")
    return commits, patches


def has_patch() -> Column:
    """Commits whose changes are read: not a merge (a parentless commit shows no parent diff)."""
    return ~F.col("is_merge") & (F.length("patch") > 0)


def with_parent(commits: DataFrame) -> DataFrame:
    """Commits that have exactly one parent."""
    return commits.where(F.col("parent_hash").isNotNull() & ~F.col("is_merge"))


def newest(commits: DataFrame, n: int) -> DataFrame:
    """First n commits, newest first (a top-n, no global sort)."""
    return commits.orderBy(F.desc("committed_at"), "commit_hash").limit(n)


def recent_commits(commits: DataFrame, file_diffs: DataFrame | None = None, path: str | None = None,
                   limit: int = 10) -> DataFrame:
    """Newest commits, optionally only those that touch `path`: hash, short_hash, message, author, date (ISO text).

    The date has the commit's own offset where the table has it (`committed_date`), else that of the session.
    """
    if path is not None:
        touching = file_diffs.where(F.col("file_path") == path).select("commit_hash")
        commits = commits.join(touching, "commit_hash", "left_semi")
    return newest(commits, limit).select(
        F.col("commit_hash").alias("hash"), F.substring("commit_hash", 1, 8).alias("short_hash"), "message", "author",
        (F.coalesce("committed_date", iso_date(F.col("committed_at"))) if "committed_date" in commits.columns
         else iso_date(F.col("committed_at"))).alias("date"))


def iso_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def commit_by_hash(commits: DataFrame, commit_hash: str) -> DataFrame:
    return commits.where(F.col("commit_hash") == commit_hash)


def with_sequence(commits: DataFrame) -> DataFrame:
    """Add seq, 0 for the newest commit, commits without a time last; commits of one time by a digest of their hash.

    A mass import at one time stamp is split by that digest, so no task numbers more than a bounded part of it.
    """
    age = F.coalesce(-F.unix_micros("committed_at"), F.lit(2**63 - 1))
    numbered = running_total(commits, [], age, ["commit_hash"], F.lit(1), "_n")
    return numbered.withColumn("seq", F.col("_n") - 1).drop("_n")


def files_as_of(snapshots: DataFrame, requests: DataFrame, path: str = "file_path", seq: str = "seq",
                content: str = "content") -> DataFrame:
    """Content of each requested (path, seq) at that commit: the nearest version at or before it, '' when absent.

    Sequence 0 is the newest commit, so "at or before" is the smallest snapshot sequence not below the request's. Contents
    are exchanged once, by range of (path, sequence). A null path is a path like any other; a request without a sequence
    finds nothing and a snapshot without one is not found; of several snapshots with one sequence the one with the
    greatest content hash counts.
    """
    rows = snapshots.where(F.col(seq).isNotNull()).select(
        path, seq, F.col(content).alias("_content"), F.lit(True).alias("_is_version")).unionByName(
        requests.withColumn("_is_version", F.lit(False)), allowMissingColumns=True)
    order = [F.col(path), F.col(seq).desc_nulls_first(), F.col("_is_version").desc(), F.xxhash64("_content")]
    found = carried(rows, [path], order, "_is_version", ["_content"])
    return found.where("NOT _is_version").select(
        *requests.columns, F.coalesce("last__content", F.lit("")).alias("content"))


def previous_versions(versions: DataFrame, path: str = "file_path", seq: str = "seq", content: str = "content") -> DataFrame:
    """Versions (seq growing with time) with `old_content`, the content of the version before; null for the first."""
    order = [F.col(path), F.col(seq), F.xxhash64(content)]
    rows = versions.withColumn("_is_version", F.lit(True))
    found = carried(rows, [path], order, "_is_version", [content], before=True)
    return found.withColumnRenamed(f"last_{content}", "old_content").drop("_is_version")


def patch_column(df: DataFrame, diff: str, key: str) -> DataFrame:
    """Staged or unstaged diff text in any table, as patches."""
    return df.select(F.col(key).cast("string").alias("commit_hash"), F.col(diff).alias("patch"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole source files for review: path, value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
