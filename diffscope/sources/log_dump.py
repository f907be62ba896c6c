"""`git log -p` dumps as a Spark data source: byte ranges as partitions, date filters pushed down, patches only if asked for.

    read_dump(spark, folder, patch=False)        # or, registered, spark.read.format("commit_log").load(folder)

Options: `path`; `patch` (default true), without which patch texts are neither kept nor sent to the JVM; `split_bytes`, the
size of a byte range (64 MB). A range owns the commits whose header begins in it and reads on to the end of the last one,
so files of any size split, and a single commit may be larger than a range. Comparisons of
`committed_at` with a constant leave commits out in the reader (the setting `spark.sql.python.filterPushdown.enabled` has
to be on, which `read_dump` sees to); Spark applies them again, so that the result does not depend on it.

The dump is that of `git log -p --date=iso-strict --parents`. Files are opened by pyarrow: local folders, or any scheme it
knows. Defined cases: an empty file or text before the first header has no commits; bytes that are not UTF-8 become
replacement characters; an author or date that is missing is null; a commit without a diff has an empty patch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
                                    InputPartition, LessThan, LessThanOrEqual)

SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
HEADER = re.compile(rb"(?m)^commit ([0-9a-f]{40})(?: [0-9a-f]{40})*\r?$")
MARGIN = timedelta(days=1)  # a naive constant may be meant in any time zone

COLUMNS = {"commit_hash": "string", "parent_hash": "string", "is_merge": "boolean", "author": "string",
           "committed_at": "timestamp", "committed_date": "string", "message": "string"}
ARROW = {"string": pa.string(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", tz="UTC")}


@dataclass
class ByteRange(InputPartition):
    path: str
    low: int
    high: int

    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


def file_system(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    parsed = urlparse(path)
    return (LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else FileSystem.from_uri(path)


def records(read, low: int, high: int) -> Iterator[bytes]:
    """Texts of the commits whose header begins in [low, high); `read(position, size)` gives bytes, b'' at the end."""
    base = max(0, low - 1)  # one byte more, so that a header at `low` is known to begin a line
    buffer, start, seen, ended = bytearray(), None, 0, False
    while not ended:
        more = read(base + len(buffer), READ_BYTES)
        ended = not more
        buffer += more
        whole = len(buffer) if ended else buffer.rfind(b"\n") + 1  # only complete lines are looked at
        for at in [found.start() for found in HEADER.finditer(buffer, seen, max(seen, whole))]:
            if base + at < low:
                continue
            if start is not None:
                yield bytes(buffer[start:at])
            start = at
            if base + start >= high:
                return
        seen = max(seen, whole)
        if start is None and base + seen >= high:
            return
        keep = (seen if start is None else start) - 1  # with the byte before, which ends a line
        if keep > 0 and not ended:
            del buffer[:keep]
            base, seen, start = base + keep, seen - keep, None if start is None else start - keep
    if start is not None:
        yield bytes(buffer[start:])


def _date(text: str | None) -> datetime | None:
    try:
        found = datetime.fromisoformat(text) if text else None
    except ValueError:
        return None
    return found.astimezone(timezone.utc) if found and found.tzinfo else found.replace(tzinfo=timezone.utc) if found else None


def parse_record(record: bytes, patch: bool) -> dict:
    """Columns of one commit."""
    diff = record.find(b"\ndiff --git ")
    head = record[:diff] if diff >= 0 else record
    first, _, body = head.decode("utf-8", "replace").partition("\n\n")
    lines = first.split("\n")
    hashes = re.findall("[0-9a-f]{40}", lines[0])
    fields = dict(line.split(":", 1) for line in lines[1:] if ":" in line)
    author = fields.get("Author", "").strip()
    date = (fields.get("CommitDate") or fields.get("Date") or "").strip()
    out = {
        "commit_hash": hashes[0], "parent_hash": hashes[1] if len(hashes) > 1 else None,
        "is_merge": "Merge" in fields or len(hashes) > 2, "author": re.sub(r"\s+<[^>]*>$", "", author) or None,
        "committed_at": _date(date), "committed_date": date or None,
        "message": "\n".join(line.removeprefix("    ") for line in body.split("\n")).rstrip()}
    if patch:
        out["patch"] = record[diff + 1:].decode("utf-8", "replace").rstrip("\n") if diff >= 0 else ""
    return out


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.patch = options.get("patch", "true").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.least = self.most = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("committed_at",) and isinstance(getattr(f, "value", None), datetime):
                value = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least = max(filter(None, (self.least, value - MARGIN)))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.most = min(filter(None, (self.most, value + MARGIN)))
            yield f

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        return [ByteRange(f.path, low, min(low + self.split, f.size)) for f in files
                if f.type == FileType.File and not f.base_name.startswith(("_", "."))
                for low in range(0, f.size, self.split)]

    def read(self, partition: ByteRange):
        fs, _ = file_system(self.path)
        kinds = {**COLUMNS, **({"patch": "string"} if self.patch else {})}
        schema = pa.schema([(n, ARROW[k]) for n, k in kinds.items()])
        rows, held = [], 0
        with fs.open_input_file(partition.path) as f:
            size = f.size()
            for record in records(lambda at, n: f.read_at(min(n, max(0, size - at)), at), partition.low, partition.high):
                row = parse_record(record, self.patch)
                when = row["committed_at"]
                if when is not None and ((self.least and when < self.least) or (self.most and when > self.most)):
                    continue
                rows.append(row)
                held += len(record) if self.patch else 500
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class LogDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        patch = self.options.get("patch", "true").lower() == "true"
        return ", ".join(f"{n} {k}" for n, k in {**COLUMNS, **({"patch": "string"} if patch else {})}.items())

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def read_dump(spark: SparkSession, path: str, patch: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Commits of a log dump, with filters on their date pushed down."""
    spark.dataSource.register(LogDump)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(LogDump.name()).option("patch", str(patch).lower()).option("split_bytes", split_bytes).load(path)
