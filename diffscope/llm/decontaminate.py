"""Benchmark decontamination: exact containment of item windows, by a prefix-filtered set join.

A window is `length` consecutive words of an item (a shorter item is one window). Its shingles are its runs of three
words. As a window must be contained whole, its necessary prefix under any order is one shingle; ordered by rarity that
is the shingle which occurs least often in the documents, counted over all of them. Documents are probed for these
anchors only. An anchor at word i that stands at position p of its window bounds the place (it starts at i - p >= 0) and
the length (i - p + length <= words of the document); what passes is verified word for word over the item-sized window.

Documents are never shuffled. The benchmark's index is kept in blocks of at most `block_windows` windows in the shared
folder; a task holds one block at a time, so a benchmark of any size works, in more passes over each batch.

Defined cases: null or empty text has no words and is not contaminated; items without words match nothing; repeated
items and equal windows of several items all count, each item once per document; items with a null id hit words, but
are not listed; repeated documents each get their row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffscope.llm.store import Files, shared_folder, written
from diffscope.llm.words import NOT_ALPHANUMERIC, BlockHasher, Words, chunks, signed

LENGTH = 10
SHINGLE = 3
BLOCK_WINDOWS = 200_000  # 200,000 windows are about 30 MB in a task
BITMAP_BITS = 20


def _windows(items: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(item, window: word hashes) of every window, each once per item."""

    def run(batches):
        hasher = BlockHasher(NOT_ALPHANUMERIC, fold=True)
        for b in batches:
            for low, data, offsets in chunks(b.column(1)):
                words = hasher.words(data, offsets)
                owners, found = [], []
                for d in range(len(offsets) - 1):
                    h = words.hash[words.first[d]:words.first[d + 1]]
                    size = min(length, len(h))
                    if size:
                        rows = np.lib.stride_tricks.sliding_window_view(h, size)
                        found += [row.tobytes() for row in rows]
                        owners += [b.column(0)[low + d].as_py()] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(found, pa.binary())],
                                                 ["item", "window"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(
        run, "item string, window binary").distinct()


class Block:
    """Windows of one block: distinct word sequences, and the items of each."""

    def __init__(self, windows: list[np.ndarray], items: list[list[str]]):
        self.windows, self.items = windows, items

    def shingles(self, hasher: BlockHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window number, position, hash) of all shingles of all windows."""
        no, at, hashes = [], [], []
        for i, w in enumerate(self.windows):
            q = min(SHINGLE, len(w))
            found = shingle_hashes(hasher, w, np.array([0, len(w)]), q)[1]
            no.append(np.full(len(found), i))
            at.append(np.arange(len(found)))
            hashes.append(found)
        return np.concatenate(no), np.concatenate(at), np.concatenate(hashes)

    def save(self, files: Files, name: str, anchors: np.ndarray, position: np.ndarray) -> None:
        out = io.BytesIO()
        sizes = np.array([len(w) for w in self.windows])
        order = np.argsort(anchors, kind="stable")
        flat = [x for names in self.items for x in names]
        np.savez(out, words=np.concatenate(self.windows), sizes=sizes, anchors=anchors[order], window=order,
                 position=position[order], item_counts=np.array([len(x) for x in self.items]))
        files.write(name, out.getvalue())
        files.write(f"{name}.items", json.dumps(flat).encode())


def shingle_hashes(hasher: BlockHasher, words: np.ndarray, first: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    return hasher.grams(Words(words, words, words, first), q, 20)


class Index:
    """A block as read by a task."""

    def __init__(self, files: Files, name: str):
        data = np.load(io.BytesIO(files.read(name)))
        self.words, self.sizes = data["words"], data["sizes"]
        self.start = np.concatenate(([0], np.cumsum(self.sizes)))
        self.anchors, self.window, self.position = data["anchors"], data["window"], data["position"]
        ends = np.cumsum(data["item_counts"])
        names = json.loads(files.read(f"{name}.items"))
        self.items = [names[e - c:e] for e, c in zip(ends.tolist(), data["item_counts"].tolist())]
        shift = np.uint64(64 - BITMAP_BITS)
        self.bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.bitmap[(self.anchors >> shift).astype(np.int64)] = True
        self.shift = shift
        self.lengths = sorted({min(SHINGLE, int(s)) for s in set(self.sizes.tolist())})

    def matches(self, hasher: BlockHasher, words) -> Iterator[tuple[int, int, int]]:
        """(document, first word, window) of every verified occurrence."""
        doc_of = np.repeat(np.arange(len(words.first) - 1), words.counts)
        for q in self.lengths:
            at, h = shingle_hashes(hasher, words.hash, words.first, q)
            maybe = np.flatnonzero(self.bitmap[(h >> self.shift).astype(np.int64)])
            low = np.searchsorted(self.anchors, h[maybe], side="left")
            high = np.searchsorted(self.anchors, h[maybe], side="right")
            for i, a, z in zip(at[maybe].tolist(), low.tolist(), high.tolist()):
                for j in range(a, z):
                    w = int(self.window[j])
                    size = int(self.sizes[w])
                    d = int(doc_of[i])
                    s = i - int(self.position[j])
                    if min(SHINGLE, size) != q or s < words.first[d] or s + size > words.first[d + 1]:
                        continue
                    if np.array_equal(words.hash[s:s + size], self.words[self.start[w]:self.start[w + 1]]):
                        yield d, s - int(words.first[d]), w


def _counts(texts: DataFrame, folder: str, name: str) -> DataFrame:
    """(shingle, count): how often each shingle of a block occurs in the documents."""

    def run(batches):
        hasher = BlockHasher(NOT_ALPHANUMERIC, fold=True)
        wanted = np.load(io.BytesIO(Files(folder).read(name)))
        bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
        shift = np.uint64(64 - BITMAP_BITS)
        totals = {q: np.zeros(len(wanted[str(q)]), dtype=np.int64) for q in range(1, SHINGLE + 1)}
        lists = {q: wanted[str(q)] for q in totals if len(wanted[str(q)])}
        for h in lists.values():
            bitmap[(h >> shift).astype(np.int64)] = True
        for b in batches:
            for _, data, offsets in chunks(b.column(0)):
                words = hasher.words(data, offsets)
                for q, known in lists.items():
                    _, h = shingle_hashes(hasher, words.hash, words.first, q)
                    h = h[bitmap[(h >> shift).astype(np.int64)]]
                    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    np.add.at(totals[q], place[known[place] == h], 1)
        for q, known in lists.items():
            some = totals[q] > 0
            yield pa.RecordBatch.from_arrays([pa.array(signed(known[some])), pa.array(totals[q][some])],
                                             ["shingle", "count"])

    return texts.mapInArrow(run, "shingle long, count long").groupBy("shingle").agg(F.sum("count").alias("count"))


def build_index(documents: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                item_text: str = "text", length: int = LENGTH, block_windows: int = BLOCK_WINDOWS) -> tuple[str, int]:
    """Write the index of the items, block by block: (folder, number of blocks)."""
    windows = written(_windows(items, item_id, item_text, length).groupBy("window").agg(
        F.collect_set("item").alias("items")), "item-windows")
    blocks = -(-windows.count() // block_windows)
    folder = shared_folder(documents.sparkSession, "item-index")
    files = Files(folder)
    files.make()
    hasher = BlockHasher(NOT_ALPHANUMERIC, fold=True)
    texts = documents.select(F.col(text_col).alias("text"))
    for i in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i).orderBy("window").collect()
        if not rows:
            rows = windows.limit(1).collect()  # a block must not be empty; a window may be in two
        block = Block([np.frombuffer(r.window, dtype=np.uint64) for r in rows], [sorted(r["items"]) for r in rows])
        no, at, h = block.shingles(hasher)
        q = np.minimum(SHINGLE, np.array([len(w) for w in block.windows]))[no]
        lists = io.BytesIO()
        np.savez(lists, **{str(k): np.unique(h[q == k]) for k in range(1, SHINGLE + 1)})
        files.write(f"shingles-{i}", lists.getvalue())
        counts = {r["shingle"]: r["count"] for r in _counts(texts, folder, f"shingles-{i}").collect()}
        frequency = np.array([counts.get(x, 0) for x in signed(h).tolist()])
        order = np.lexsort((at, h, frequency, no))
        first = order[np.concatenate(([True], no[order][1:] != no[order][:-1]))]
        block.save(files, f"block-{i}", h[first], at[first])
    return folder, blocks


def contamination(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", length: int = LENGTH,
                  block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids of the items with occurring windows).

    `keep` names columns of `documents` that are passed on (under the prefix `keep_`).
    """
    folder, blocks = build_index(documents, items, text_col, item_id, item_text, length, block_windows)

    def run(batches):
        hasher = BlockHasher(NOT_ALPHANUMERIC, fold=True)
        files, held = Files(folder), {}
        for b in batches:
            n_words: list[int] = []
            n_hit = np.zeros(b.num_rows, dtype=np.int64)
            items_of: list[set] = [set() for _ in range(b.num_rows)]
            parts = [(low, hasher.words(data, offsets)) for low, data, offsets in chunks(b.column(1))]
            spans: dict[int, list[tuple[int, int]]] = {}
            for _, words in parts:
                n_words += words.counts.tolist()
            for i in range(blocks):
                if i not in held:
                    held.clear()
                    held[i] = Index(files, f"block-{i}")
                index = held[i]
                for low, words in parts:
                    for d, start, w in index.matches(hasher, words):
                        spans.setdefault(low + d, []).append((start, start + int(index.sizes[w])))
                        items_of[low + d].update(index.items[w])
            for d, found in spans.items():
                end = 0
                for s, e in sorted(found):
                    n_hit[d] += max(0, e - max(s, end))
                    end = max(end, e)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit),
                 pa.array([sorted(x) for x in items_of], pa.list_(pa.string())), *b.columns[2:]],
                ["doc_id", "n_words", "n_hit", "items", *[f"keep_{c}" for c in keep]])

    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = f"doc_id {fields[id_col]}, n_words long, n_hit long, items array<string>" + "".join(
        f", keep_{c} {fields[c]}" for c in keep)
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[
        F.col(c).alias(f"keep_{c}") for c in keep]).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE_SQL = f"""
WITH items AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
            SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items WHERE k > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
           FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS (SELECT doc_id, i, p.k, item_id FROM places p JOIN windows v
          ON v.k = p.k AND v.s = array_to_string(p.w[i:i + p.k - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (
         SELECT doc_id, unnest(range(i, i + k)) AS x FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS names FROM (
           SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)"""
