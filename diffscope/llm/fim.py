"""Fill-in-the-middle transformation by secondary-sort assembly.

A document is cut into units, a word with the white space before it (or white space at the end). Hashes of its id decide
the form (plain, psm, spm) and after how many units prefix and middle end. Each document goes out as pieces of whole units,
keyed by document and position in the output, marks being pieces of their own. Pieces are dealt by key and sorted within
partitions, so a stream of them is the output texts piece by piece: digests are fed as it passes and no text is ever held
whole. What the stream reads, form and marks, gives each piece its place in the text before the transformation; a second
sort inside the same partitions (no second exchange) streams the restored texts.

Rows are told apart by a digest of id and text. Equal rows are one document that remembers its copies; a task sends each
once, so a row that a third of the table repeats costs one document a task. A very long text is many pieces, but one key.

Defined cases: null text is empty text, which stays plain, without units or pieces' text; a null id is the empty decimal;
repeated rows come out as often as they came in; different texts with one id are documents of their own with the same
hashes; columns other than id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.llm.words import WHITE_SPACE, chunks

# Marks of the three parts, in their order in the text, and the order of parts in each form's output.
MARKS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PLAIN = "plain"

PIECE_BYTES = 1 << 16
BATCH_BYTES = 4 << 20
EXTRA = -1  # place of a row that only counts further copies
END = 1 << 62  # place of the row that ends a restored document
PIECE = ["key", "place", "piece", "copies", "doc_id", "n", "form", "prefix_chars", "middle_chars"]


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which units end, for texts that lie behind each other in `data`."""
    inside = np.ones(256, dtype=bool)
    inside[list(WHITE_SPACE)] = False
    end = inside[data]
    end[:-1] &= ~end[1:]
    end[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return np.flatnonzero(end) + 1


def plan(doc_id, text: bytes, n: int, seed: int, rate: int, spm: int) -> tuple[str, int, int]:
    """Form of a document and the units after which its prefix and its middle end."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12))
    if not text or h3 % 100 >= rate or (b"<" in text and any(mark in text for mark in MARKS)):
        return PLAIN, 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < spm else "psm", low, high


def pieces(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50,
           spm: int = 80, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The output texts as pieces (key, place, piece), ordered by key and place within partitions.

    The first piece of a document (place 0) also has doc_id, n (units), form, prefix_chars and middle_chars. Equal pieces
    of one key and place come from copies; rows of place -1 count further copies in `copies`.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        seen: dict[bytes, int] = {}
        out, held = [], 0
        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            ids = b.column(0).to_pylist()
            for low, data, offsets in chunks(b.column(1)):
                ends = unit_ends(data, offsets)
                first = np.searchsorted(ends, offsets, side="right")
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                raw = data.tobytes()
                for d in range(len(offsets) - 1):
                    a, z = int(offsets[d]), int(offsets[d + 1])
                    text, doc = raw[a:z], ids[low + d]
                    key = hashlib.blake2b(f"{doc is None}{doc}\0".encode() + text, digest_size=16).digest()
                    if key in seen:
                        seen[key] += 1
                        continue
                    seen[key] = 0
                    mine = ends[first[d]:first[d + 1]] - a
                    form, low_cut, high_cut = plan(doc, text, len(mine), seed, rate, spm)
                    cuts = [0, *(int(mine[c - 1]) if c else 0 for c in (low_cut, high_cut)), z - a]
                    meta = (1, doc, len(mine), form, *((None, None) if form == PLAIN else (
                        int(chars[a + cuts[i + 1]] - chars[a + cuts[i]]) for i in (0, 1))))
                    for place, part in enumerate(_output(text, mine, form, cuts, piece_bytes)):
                        out.append((key, place, part, *(meta if place == 0 else (None,) * 6)))
                        held += len(part) + 64
                    if held >= BATCH_BYTES:
                        yield _batch(out, id_type)
                        out, held = [], 0
        for key, copies in seen.items():
            if copies:
                out.append((key, EXTRA, None, copies, *(None,) * 5))
            if len(out) >= 50_000:
                yield _batch(out, id_type)
                out = []
        if out:
            yield _batch(out, id_type)

    found = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"key binary, place long, piece binary, copies long, doc_id {kind}, n long, form string, "
             "prefix_chars long, middle_chars long")
    return found.repartition("key").sortWithinPartitions("key", "place")


def _output(text: bytes, ends: np.ndarray, form: str, cuts: list[int], most: int) -> Iterator[bytes]:
    """Pieces of the output, in order; at least one, as an empty text has its row as well."""
    if form == PLAIN:
        yield from _split(text, ends, 0, len(text), most) if text else (b"",)
        return
    for part in ORDERS[form]:
        yield MARKS[part]
        yield from _split(text, ends, cuts[part], cuts[part + 1], most)


def _split(text: bytes, ends: np.ndarray, low: int, high: int, most: int) -> Iterator[bytes]:
    """Pieces of whole units of text[low:high], of at most `most` bytes unless one unit is longer."""
    while high - low > most:
        i = int(np.searchsorted(ends, low + most, side="right")) - 1
        cut = int(ends[i]) if i >= 0 and ends[i] > low else int(ends[i + 1])
        if cut >= high:
            break
        yield text[low:cut]
        low = cut
    if high > low:
        yield text[low:high]


def _batch(rows: list[tuple], id_type) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), id_type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], PIECE)


def _documents(batches) -> Iterator[tuple]:
    """(key, piece, meta or None) of each piece once, and (key, None, copies) after the last one of a document."""
    key, last, copies = None, None, 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != key:
                if key is not None:
                    yield key, None, copies
                key, last, copies = row[0], None, 0
            place = row[1]
            if place <= 0:  # the head of each copy, or a count
                copies += row[3]
            if place != EXTRA and place != last:
                last = place
                yield key, row[2], row[4:] if place == 0 else None
    if key is not None:
        yield key, None, copies


def texts(found: DataFrame) -> DataFrame:
    """The outputs as whole texts: doc_id, n, form, prefix_chars, middle_chars, output. Needs room for the longest one."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        meta, parts, id_type = None, [], None

        def watched():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(4).type
                yield b

        for _, piece, info in _documents(watched()):
            if piece is not None:
                meta, parts = info or meta, [*parts, piece] if info is None else [piece]
                continue
            row = (*meta, b"".join(parts).decode())
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v] * info, t) for v, t in zip(row, types)], [*PIECE[4:], "output"])

    return found.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from output and form alone: marks occur in no text that was transformed."""
    def part(mark: str) -> Column:  # up to the next mark or the end
        return F.regexp_extract(output, f"(?s){mark}(.*?)(?=<[PSM]>|\\z)", 1)

    return F.when(form == PLAIN, output).otherwise(F.concat(*(part(m.decode()) for m in MARKS)))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Both digests are fed piece by piece: by the output as it is streamed, then, sorted anew within the same partitions, by
    the text that form and marks restore.
    """
    kind = found.schema["doc_id"].dataType.simpleString()
    whole = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"

    def read(batches):
        id_type = None

        def watched():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(4).type
                yield b

        def batch():
            types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), id_type, pa.int64(), pa.string(), pa.int64(),
                     pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*PIECE, "output_sha256"])

        out, held, digest, meta, part, at = [], 0, None, None, 0, 0
        for key, piece, info in _documents(watched()):
            if piece is None:
                out.append((key, END, None, info, *meta, digest.hexdigest()))
            else:
                if info is not None:
                    digest, meta, part, at = hashlib.sha256(), info, 0, 0
                digest.update(piece)
                if meta[2] != PLAIN and piece in MARKS:
                    part, at = MARKS.index(piece), 0
                elif piece:
                    out.append((key, (part << 48) + at, piece, *(None,) * 7))
                    at += 1
                held += len(piece) + 64
            if held >= BATCH_BYTES or len(out) >= 50_000:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    def restore(batches):
        digest = hashlib.sha256()
        for b in batches:
            rows = []
            key, place, piece, copies = (b.column(i).to_pylist() for i in range(4))
            for i, (at, part) in enumerate(zip(place, piece)):
                if at == END:
                    rows.append((i, digest.hexdigest(), copies[i]))
                    digest = hashlib.sha256()
                else:
                    digest.update(part)
            if rows:
                repeats = pa.array(np.repeat([r[0] for r in rows], [r[2] for r in rows]))
                again = pa.array(np.repeat([r[1] for r in rows], [r[2] for r in rows]).tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([*(c.take(repeats) for c in b.columns[4:]), again],
                                                 [*PIECE[4:], "output_sha256", "restored_sha256"])

    streamed = found.mapInArrow(read, f"key binary, place long, piece binary, copies long, {whole}")
    return streamed.sortWithinPartitions("key", "place").mapInArrow(restore, f"{whole}, restored_sha256 string")


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''),
         '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
numbers AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
forms AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
         array_to_string(units[b + 1:], '') AS s FROM forms)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""
