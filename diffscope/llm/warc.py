"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by page-id range and sorted by (page id, payload digest), so the same rows give the same
files, byte for byte, whatever partitions they come in. A shard rolls to a new file when its compressed size reaches
`roll_bytes`. Headers, lengths, record ids and digests are made anew from the content. Tasks write under temporary
names; the driver moves the files of finished tasks to their names and writes the manifest last, and a reader trusts
the manifest only, so retried or lost tasks leave nothing that is read.

Of records with equal payloads of at least `revisit_bytes`, the one with the largest page id is a response and the
others are revisits of it. Which one is settled on digests alone (a maximum per digest, combined before the shuffle);
the decision travels to the shard of each revisit as a row that sorts before its page, so payloads are shuffled once.

Defined cases: a null payload is empty; a null page id sorts last, is always a response and is never referred to; of
rows with the page id that stays a response the first is the response, the repeated ones revisit it; a null url gives no
target header; control characters in urls are percent-encoded; an empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffscope.llm.ranges import cuts, dealt, place, shard_of
from diffscope.llm.store import Files, shared_folder, written

REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
RESULT = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
          "file string")


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: bytes, copy: int) -> str:
    name = hashlib.sha1(f"{page_id}/{digest.hex()}/{copy}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def _member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as one gzip member (no time stamp, so equal records are equal bytes)."""
    fields = [*fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url, payload: bytes, digest: bytes, refers_to, copy: int, date: str, level: int = 6) -> bytes:
    """A response, or a revisit of the response of page `refers_to`; its HTTP headers keep the payload's length."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0)),
                   ("X-Refers-To-Page-ID", str(refers_to))]
    block = http + (payload if refers_to is None else b"")
    fields += [("WARC-Payload-Digest", _b32(digest)), ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
               ("Content-Type", "application/http; msgtype=response")]
    return _member(fields, block, level)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               revisit_bytes: int = REVISIT_BYTES, shard_bytes: int = 64 << 20, roll_bytes: int = 32 << 20,
               date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of `pages`, and the manifest, to `folder`."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    keyed = pages.select(place(id_col).alias("place"), F.col(id_col).cast("long").alias("page_id"),
                         F.col(url_col).alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"),
                         F.octet_length(payload).cast("long").alias("bytes"))
    slim = written(keyed.select("place", "page_id", "digest", "bytes"), "page-digests")
    where = cuts(slim, shard_bytes)
    large = slim.where((F.col("bytes") >= revisit_bytes) & F.col("page_id").isNotNull())
    kept = large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    decisions = large.join(kept, "digest").select("place", "digest", "kept").distinct()
    rows = keyed.select("place", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("kept"), "page_id",
                        "url", "payload").unionByName(
        decisions.withColumn("kind", F.lit(0)), allowMissingColumns=True).withColumn("shard", shard_of(where, F.col("place")))
    files = Files(folder)
    files.make("_temporary")

    def run(batches):
        out, shard, roll = Files(folder), None, 0
        file = name = temporary = None
        size = records = 0
        before, copy, decision = None, 0, None

        def close():
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([temporary]), pa.array([size], pa.int64()),
                                               pa.array([records], pa.int64())], ["name", "temporary", "bytes", "records"])

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for at, spot, digest, kind, keep, page_id, url, text in zip(*columns):
                if (at, spot, digest) != before:
                    before, copy, decision = (at, spot, digest), 0, None
                if kind == 0:
                    decision = keep
                    continue
                if file is not None and (at != shard or size >= roll_bytes):
                    yield close()
                    file, roll = None, roll + 1 if at == shard else 0
                if file is None:
                    shard, size, records = at, 0, 0
                    name, temporary = f"pages-{at:06d}-{roll:04d}.warc.gz", f"_temporary/{uuid.uuid4().hex}"
                    file = out.create(temporary)
                    about = f"software: diffscope\r\nformat: WARC File Format 1.1\r\nfile: {name}\r\n".encode()
                    first = _member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Filename", name),
                                     ("WARC-Record-ID", record_id(None, name.encode(), 0)),
                                     ("Content-Type", "application/warc-fields")], about, 6)
                    file.write(first)
                    size += len(first)
                revisits = decision is not None and (decision != page_id or copy > 0)
                record = page_record(page_id, url, text.encode(), digest, decision if revisits else None, copy, date)
                file.write(record)
                size, records, copy = size + len(record), records + 1, copy + 1
        if file is not None:
            yield close()

    order = dealt(rows, where, "place", "digest", "kind", "url").select(
        "shard", "place", "digest", "kind", "kept", "page_id", "url", "payload")
    done = order.mapInArrow(run, "name string, temporary string, bytes long, records long").collect()
    manifest = []
    for row in sorted(done, key=lambda r: r["name"]):  # one row per file
        files.move(row["temporary"], row["name"])
        manifest.append({"name": row["name"], "bytes": row["bytes"], "records": row["records"]})
    files.write("_temporary/manifest", json.dumps({"files": manifest}).encode())
    files.move("_temporary/manifest", "MANIFEST.json")
    files.remove_folder("_temporary")


def members(stream, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of a file, one gzip member after the other."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(step)):
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("truncated record")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record; its length and digests are verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    if rest[len(block):] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
        raise ValueError("record length")
    if (said := fields.get("warc-block-digest")) and said != _b32(hashlib.sha1(block).digest()):
        raise ValueError("block digest")
    return fields, block


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page record of the files of the manifest (revisits have no payload of their own)."""
    manifest = json.loads(Files(folder).read("MANIFEST.json"))["files"]

    def run(batches):
        files = Files(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with files.open(name) as stream:
                    for record in members(stream):
                        fields, block = parsed(record)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32decode(fields["warc-payload-digest"][5:])
                        if fields["warc-type"] == "response" and (
                                len(payload) != length or hashlib.sha1(payload).digest() != digest):
                            raise ValueError(f"payload of {fields['warc-record-id']}")
                        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append((page and int(page), length, digest.hex(), fields["warc-type"],
                                     refers and int(refers), fields.get("warc-target-uri"), name,
                                     payload if with_payload else None))
                        if len(rows) >= 1000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)][:8 if with_payload else 7],
                                          names[:8 if with_payload else 7])

    schema = RESULT + (", payload binary" if with_payload else "")
    if not manifest:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(m["name"], i) for i, m in enumerate(manifest)], "name string, no int")
    return names.repartitionById(len(manifest), F.col("no")).select("name").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` to a new shared folder and read the records back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                        "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS kept FROM k GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN kept END AS refers_to
FROM k JOIN m USING (payload_digest)"""
