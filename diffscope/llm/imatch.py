"""I-Match fingerprints: terms within a band of inverse document frequency, hashed under several random lexicons.

The lexicon holds the terms that occur in at least `least` and at most `most` of all documents. Document frequencies are
exact counts over all documents in two passes. The first names candidates: each task sends the terms that reach half that
share of its own documents, and a term stays if the counts sent exceed half the share by as much as they must for a term
of the whole share. As every candidate fills a fixed share of the documents, there are at most (distinct terms of a
document, on average) x 2 / `least` of them, however many documents and tasks there are. The second pass counts them, in
blocks of bounded size.

A fingerprint is the hash of all lexicon terms of a text, sorted and distinct, and 48 hashes of the terms that fall into
a random part of the lexicon (a 16th, a 64th or a 256th, 16 each). Parts without a term of the text are empty. The
likeness of two fingerprints is the share of equal parts among those not empty in both; a part is
equal only if all its terms are. Texts without lexicon terms are compared by the hash of all their terms.

Defined cases: null text is empty text; equal texts have equal fingerprints; empty texts are alike; rows with the same id
are ordered by a hash of the text; null ids sort last; a single document follows itself; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffscope.llm.ranges import cuts, dealt, place, shard_of
from diffscope.llm.store import Files, shared_folder, written
from diffscope.llm.words import MULTIPLIER, NOT_ALPHANUMERIC, BlockHasher, chunks, mixed, signed

LEAST, MOST = 1 / 1000, 1 / 20
RATES = (16, 64, 256)
PER_RATE = 16
PARTS = len(RATES) * PER_RATE
BLOCK_TERMS = 1 << 22  # candidates counted at a time: 32 MB in a task
BITMAP_BITS = 22


def _document_terms(hasher: BlockHasher, texts: pa.Array):
    """Per chunk of texts: (first text, number of texts, text and hash of each distinct term, sorted by text and hash)."""
    for low, data, offsets in chunks(texts):
        words = hasher.words(data, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), words.counts)
        order = np.argsort(words.hash, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        h, d = words.hash[order], doc[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, dtype=bool)
        yield low, len(offsets) - 1, d[new], h[new]


def _candidates(texts: DataFrame, least: float, total: int) -> DataFrame:
    """(term): all that reach the share `least` of the `total` documents, and others, but none below half of it.

    A task with d documents sends a term that at least d x least / 2 of them hold. What tasks do not send is less than that
    for each of them, so a term of the whole share has sent counts that exceed their tasks' d x least / 2 by total x least / 2.
    """
    half = least / 2

    def run(batches):
        hasher, documents = BlockHasher(NOT_ALPHANUMERIC, fold=True), 0
        terms, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held, size = [], 0

        def merge():
            h = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            h, n = h[first], np.diff(np.append(first, len(h)))
            both = np.concatenate((terms, h))
            different, inverse = np.unique(both, return_inverse=True)
            return different, np.bincount(inverse, weights=np.concatenate((counts, n))).astype(np.int64)

        for b in batches:
            for _, n, _, h in _document_terms(hasher, b.column(0)):
                documents += n
                held.append(h)
                size += len(h)
                if size >= 1_000_000:
                    terms, counts = merge()
                    held, size = [], 0
        if size:
            terms, counts = merge()
        some = counts >= half * documents
        yield pa.RecordBatch.from_arrays([pa.array(signed(terms[some])), pa.array(counts[some] - half * documents)],
                                         ["term", "above"])

    sent = texts.mapInArrow(run, "term long, above double").groupBy("term").agg(F.sum("above").alias("above"))
    return sent.where(F.col("above") >= half * total * (1 - 1e-9)).select("term")  # sums of doubles: a margin


def _counted(texts: DataFrame, folder: str, name: str) -> DataFrame:
    """(term, count): documents that hold each term of a sorted list in the shared folder."""

    def run(batches):
        hasher = BlockHasher(NOT_ALPHANUMERIC, fold=True)
        known = Lexicon(np.frombuffer(Files(folder).read(name), dtype=np.uint64))
        counts = np.zeros(len(known.terms), dtype=np.int64)
        for b in batches:
            for _, _, _, h in _document_terms(hasher, b.column(0)):
                _, at = known.find(h)
                np.add.at(counts, at, 1)
        some = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(signed(known.terms[some])), pa.array(counts[some])], ["term", "count"])

    return texts.mapInArrow(run, "term long, count long").groupBy("term").agg(F.sum("count").alias("count"))


def build_lexicon(documents: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST,
                  block_terms: int = BLOCK_TERMS) -> str:
    """Write the lexicon (sorted term hashes) to the shared folder: its path."""
    texts = documents.select(F.col(text_col).alias("text"))
    folder = shared_folder(documents.sparkSession, "lexicon")
    files = Files(folder)
    files.make()
    total = texts.count()
    candidates = written(_candidates(texts, least, total), "candidate-terms")
    blocks = max(1, -(-candidates.count() // block_terms))
    lexicon = [np.zeros(0, dtype=np.uint64)]
    for i in range(blocks):
        some = candidates.where(F.pmod("term", F.lit(blocks)) == i).toPandas()["term"].to_numpy(dtype=np.int64)
        files.write(f"candidates-{i}", np.sort(some.view(np.uint64)).tobytes())
        kept = _counted(texts, folder, f"candidates-{i}").where(
            F.col("count").between(max(2.0, least * total), max(2.0, most * total))).toPandas()["term"]
        lexicon.append(kept.to_numpy(dtype=np.int64).view(np.uint64))
    files.write("terms", np.sort(np.concatenate(lexicon)).tobytes())
    return folder


class Lexicon:
    """Sorted term hashes with a bitmap in front."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.shift = np.uint64(64 - BITMAP_BITS)
        self.bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.bitmap[(terms >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in the lexicon) of the terms it holds."""
        maybe = np.flatnonzero(self.bitmap[(h >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), max(0, len(self.terms) - 1))
        same = self.terms[at] == h[maybe] if len(self.terms) else np.zeros(len(maybe), dtype=bool)
        return maybe[same], at[same]


class Fingerprinter:
    def __init__(self, terms: np.ndarray):
        self.hasher, self.lexicon = BlockHasher(NOT_ALPHANUMERIC, fold=True), Lexicon(terms)
        self.member = np.zeros(len(terms), dtype=np.uint64)  # bit k: the term is in random lexicon k
        for k in range(PARTS):
            inside = mixed(terms, 1000 + k) < np.uint64(2**64 // RATES[k // PER_RATE])
            self.member |= inside.astype(np.uint64) << np.uint64(k)
        self.steps = np.cumprod(np.full(1 << 16, MULTIPLIER, dtype=np.uint64))

    def _sequence(self, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Per document the hash of its sorted terms; 0 where it has none."""
        out = np.zeros(n, dtype=np.uint64)
        if len(h):
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            rank = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
            if rank.max() >= len(self.steps):
                self.steps = np.cumprod(np.full(int(rank.max()) + 1, MULTIPLIER, dtype=np.uint64))
            out[doc[first]] = mixed(np.add.reduceat(mixed(h, 40) * self.steps[rank], first), 41)
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of all terms, hashes of the parts) of each text."""
        whole = np.zeros(len(texts), dtype=np.uint64)
        parts = np.zeros((len(texts), PARTS), dtype=np.uint32)
        for low, n, doc, h in _document_terms(self.hasher, texts):
            at, term = self.lexicon.find(h)
            inside = self._sequence(doc[at], h[at], n)
            whole[low:low + n] = np.where(inside != 0, inside, self._sequence(doc, h, n))
            member = self.member[term]
            for k in range(PARTS):
                some = at[(member >> np.uint64(k)) & np.uint64(1) == 1]
                found = self._sequence(doc[some], h[some], n)
                parts[low:low + n, k] = ((found >> np.uint64(40)).astype(np.uint32) | np.uint32(1)) * (found != 0)
        return whole, parts


def text_form(whole: np.ndarray, parts: np.ndarray) -> list[str]:
    """16 hex digits, then six for each part (000000: empty)."""
    raw = parts.astype(">u4").view(np.uint8).reshape(len(parts), PARTS, 4)[:, :, 1:].tobytes()
    size = PARTS * 3
    return [f"{int(w):016x}{raw[i * size:(i + 1) * size].hex()}" for i, w in enumerate(whole)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    either = ((a[1] != 0) | (b[1] != 0)).sum(axis=1)
    equal = ((a[1] == b[1]) & (a[1] != 0)).sum(axis=1)
    return np.where(a[0] == b[0], 1.0, np.where(either > 0, equal / np.maximum(either, 1), 0.0))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST,
                 most: float = MOST) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    folder = build_lexicon(documents, text_col, least, most)

    def run(batches):
        maker = Fingerprinter(np.frombuffer(Files(folder).read("terms"), dtype=np.uint64))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_form(*maker.of(b.column(1))), pa.string())],
                                             ["doc_id", "fingerprint"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fingerprint string")


def edited_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST,
                        most: float = MOST, shard_bytes: int = 48 << 20) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness to each other and to the next document's.

    Documents are dealt by id range, so the next one is the next row; the first row of each shard is also sent to the
    shard before it. Texts are shuffled once.
    """
    folder = build_lexicon(documents, text_col, least, most)
    rows = documents.select(place(id_col).alias("place"), F.col(id_col).cast("long").alias("doc_id"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    sizes = written(rows.select("place", "tie", F.octet_length("text").cast("long").alias("bytes")), "sizes")
    where = cuts(sizes, shard_bytes)
    firsts = sizes.select(shard_of(where, F.col("place")).alias("shard"), F.struct("place", "tie").alias("key")).groupBy(
        "shard").agg(F.min("key").alias("key")).collect()  # one row per shard
    firsts = sorted((r["shard"], r["key"]["place"], r["key"]["tie"]) for r in firsts)
    before = [(firsts[i - 1][0], at, tie) for i, (_, at, tie) in enumerate(firsts)]
    spark = documents.sparkSession
    heads = spark.createDataFrame(before, "shard int, place long, tie long")
    # one row per `shard_bytes` of text: its size is unknown to the planner, which would shuffle all texts a second time
    sent = rows.select("place", "tie", "text").join(F.broadcast(heads), ["place", "tie"])
    every = rows.withColumn("shard", shard_of(where, F.col("place")).cast("int")).withColumn("extra", F.lit(0)).unionByName(
        sent.withColumn("extra", F.lit(1)), allowMissingColumns=True)

    def run(batches):
        maker = Fingerprinter(np.frombuffer(Files(folder).read("terms"), dtype=np.uint64))
        held: tuple | None = None  # the last row: id, text

        def result(ids, texts, following):
            """Rows for `texts`, each followed by the text of the same place in `following`."""
            every = [*texts, following[-1]]
            own = maker.of(pa.array(every, pa.string()))
            edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, following)]
            new = maker.of(pa.array(edited, pa.string()))
            mine, after = (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:])
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(text_form(*mine)),
                 pa.array(text_form(*new)), pa.array(likeness(mine, new)), pa.array(likeness(mine, after))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            ids, texts, extra = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            if held is not None:
                ids, texts, extra = [held[0], *ids], [held[1], *texts], [0, *extra]
                held = None
            end = extra.index(1) if 1 in extra else None
            while end is not None:  # a shard ends here
                if end > 0:
                    yield result(ids[:end], texts[:end], texts[1:end + 1])
                rest = end
                while rest < len(extra) and extra[rest]:
                    rest += 1
                ids, texts, extra = ids[rest:], texts[rest:], extra[rest:]
                end = extra.index(1) if 1 in extra else None
            if len(texts) > 1:
                yield result(ids[:-1], texts[:-1], texts[1:])
            if texts:
                held = (ids[-1], texts[-1])
        if held is not None:
            raise RuntimeError("a shard without the row that follows it")

    # the row that follows a shard sorts last in it
    return dealt(every, where, "extra", "place", "tie").select("doc_id", "text", "extra").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
