"""Removal of repeated passages, found by difference-cover anchors.

A window is `length` consecutive words. With a period v and a difference cover D of it, any two positions i, j have an
offset k < v at which both i + k and j + k are in D modulo v. So two equal windows share an aligned anchor: a shorter
run of length - v + 1 words that starts at a cover position in either. Only anchors are hashed and shuffled over the
whole corpus (4 of 13 positions with the default cover). Where an anchor repeats, the windows around it are extended to
their full length and compared; of equal windows all but the first lose their words. Unrepeated text sends nothing on.

Documents are ordered by (id, null ids last); rows with equal id and equal words are one document. Of documents with
equal words all but the first lose everything (if they have a window at all), so only the first is searched: copies cost
one digest each. Anchors and windows that repeat inside a task are settled there; only one of them is shuffled by its
hash, so a passage that a third of all documents share does not meet in one task. Their rows, most of what is shuffled,
name a text by the first 64 bits of its digest (`tag`). Anchors of texts with equal tags are joined to each of them, which
only adds windows to compare; windows name the id as well.

Defined cases: null or empty text has no words; texts shorter than a window lose nothing; repeated rows each get the
result of their document; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffscope.llm.store import written
from diffscope.llm.words import BlockHasher, chunks, mixed, signed

LENGTH = 20
# A difference cover (a perfect difference set) and its period.
COVER, PERIOD = (0, 1, 3, 9), 13
GROUP_ROWS = 1_000_000  # anchors or windows settled together inside a task
LAST = 2**63 - 1  # stands for a null id in the order of documents


def _ids(words) -> list[bytes]:
    """A digest of each document's words."""
    h = words.hash
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]


def _tags(ids: list[bytes]) -> np.ndarray:
    """The first 64 bits of digests, in the order of the digests."""
    first = np.frombuffer(b"".join(x[:8] for x in ids), dtype=">u8").astype(np.uint64)
    return signed(first ^ np.uint64(1 << 63))


def _marked(at: np.ndarray, sure: np.ndarray) -> pa.Array:
    """Word positions and flags as one number, in the order of the positions."""
    return pa.array((at * 2 + sure).astype(np.int32))


def _sequences(texts: DataFrame) -> DataFrame:
    def run(batches):
        hasher = BlockHasher()
        for b in batches:
            ids, sizes = [], []
            for _, data, offsets in chunks(b.column(1)):
                words = hasher.words(data, offsets)
                ids += _ids(words)
                sizes += words.counts.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(_tags(ids)), pa.array(sizes, pa.int64())],
                ["doc_id", "words", "tag", "n"])

    return texts.mapInArrow(run, "doc_id long, words binary, tag long, n long")


def _settle(keys: list[np.ndarray], spread: np.ndarray, rank: np.ndarray):
    """Sort rows by `keys` and `rank`: (index, key to shuffle by, is a repeat, has or is a repeat) of the sorted rows.

    The first of equal rows keeps its key; the others, which are settled, get a key of their own from `spread`.
    """
    index = np.lexsort((rank, *keys[::-1]))
    same = np.ones(len(index) - 1, dtype=bool)
    for k in keys:
        same &= k[index][1:] == k[index][:-1]
    later = np.concatenate(([False], same))
    some = later | np.concatenate((same, [False]))
    key = keys[0][index].copy()
    key[later] = spread[index][later]
    return index, key, later, some


def _anchors(texts: DataFrame, length: int, cover: tuple[int, ...], period: int) -> DataFrame:
    """(key, tag, mark): cover positions of each different text; marked `sure` if a task has already seen a repeat."""
    k = length - period + 1
    on = np.isin(np.arange(period), cover)

    def run(batches):
        hasher, seen = BlockHasher(), set()
        held, ids, count = [], [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            doc = np.concatenate([x[1] for x in held])
            at = np.concatenate([x[2] for x in held])
            spread = mixed(doc.astype(np.uint64) * np.uint64(1 << 32) + at.astype(np.uint64), 11) ^ h
            index, key, _, some = _settle([h], spread, np.arange(len(h)))
            return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(_tags(ids)[doc[index]]),
                                               _marked(at[index], some)], ["key", "tag", "mark"])

        for b in batches:
            for _, data, offsets in chunks(b.column(0)):
                words = hasher.words(data, offsets)
                names = _ids(words)
                fresh = np.zeros(len(names), dtype=bool)
                for d, (name, n) in enumerate(zip(names, words.counts.tolist())):
                    if n >= length and name not in seen:
                        seen.add(name)
                        fresh[d] = True
                where, h = hasher.grams(words, k)
                doc = np.repeat(np.arange(len(names)), words.counts)[where]
                at = where - words.first[doc]
                keep = fresh[doc] & on[at % period]
                held.append((h[keep], doc[keep] + len(ids), at[keep]))
                ids += names
                count += int(keep.sum())
                if count >= GROUP_ROWS:
                    yield flush()
                    held, ids, count = [], [], 0
        if count:
            yield flush()

    return texts.select("text").mapInArrow(run, "key long, tag long, mark int")


def _repeated(anchors: DataFrame) -> DataFrame:
    """(tag, at) of the anchors whose key two different places share, or that are sure already."""

    def run(batches):
        last = None  # the row before: key, tag, at, and whether its key has two places so far
        for b in batches:
            if b.num_rows == 0:
                continue
            key, tag, mark = (b.column(i).to_numpy() for i in range(3))
            at, sure = mark >> 1, (mark & 1).astype(bool)
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            new = new_key | np.concatenate(([True], (tag[1:] != tag[:-1]) | (at[1:] != at[:-1])))
            joins = last is not None and last[0] == key[0]
            if joins:
                new_key[0] = False
                new[0] = last[1:3] != (int(tag[0]), int(at[0]))
            run_no = np.cumsum(new_key) - new_key[0]
            places = np.bincount(run_no, weights=new, minlength=run_no[-1] + 1)
            if joins:
                if not last[3] and places[0] > 0:
                    yield pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.int32())],
                                                     ["tag", "at"])
                places[0] += 2 if last[3] else 1
            keep = sure | (new & (places[run_no] > 1))
            yield pa.RecordBatch.from_arrays([pa.array(tag[keep]), pa.array(at[keep])], ["tag", "at"])
            last = (int(key[-1]), int(tag[-1]), int(at[-1]), bool(places[run_no[-1]] > 1))

    return anchors.repartition("key").sortWithinPartitions("key", "tag", "mark").mapInArrow(run, "tag long, at int")


def _windows(flagged: DataFrame, length: int, period: int) -> DataFrame:
    """(key, other, place, tag, mark): windows around repeated anchors of documents (place, words, text, marks).

    Two hashes name a window. Marked `sure`: an earlier equal window was found in the same task.
    """

    def run(batches):
        hasher, seen = BlockHasher(), set()
        held, ids, count = [], [], 0

        def flush():
            h1, h2, place, start, doc = (np.concatenate([x[i] for x in held]) for i in range(5))
            tag = _tags(ids)[doc]
            rank = np.lexsort((start, tag, place))
            ranks = np.empty(len(rank), dtype=np.int64)
            ranks[rank] = np.arange(len(rank))
            spread = mixed(place.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64), 12) ^ h1
            index, key, later, _ = _settle([h1, h2], spread, ranks)
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(key)), pa.array(signed(h2[index])), pa.array(place[index]), pa.array(tag[index]),
                 _marked(start[index], later)], ["key", "other", "place", "tag", "mark"])

        for b in batches:
            places = b.column(0).to_numpy()
            marks = b.column(3)
            for low, data, offsets in chunks(b.column(2)):
                words = hasher.words(data, offsets)
                names = _ids(words)
                at1, h1 = hasher.grams(words, length)
                _, h2 = hasher.grams(words, length, 7)
                back = np.arange(period)
                for d, name in enumerate(names):
                    if name != b.column(1)[low + d].as_py() or (places[low + d], name) in seen:
                        continue  # another text with the same id, or the same row again
                    seen.add((places[low + d], name))
                    at = np.asarray(marks[low + d].values.to_numpy(zero_copy_only=False), dtype=np.int64)
                    starts = np.unique((at[:, None] - back).ravel())
                    starts = starts[(starts >= 0) & (starts <= words.counts[d] - length)]
                    here = np.searchsorted(at1, words.first[d] + starts)
                    held.append((h1[here], h2[here], np.full(len(starts), places[low + d]), starts,
                                 np.full(len(starts), len(ids))))
                    ids.append(name)
                    count += len(starts)
                    if count >= GROUP_ROWS:
                        yield flush()
                        held, ids, count = [], [], 0
        if count:
            yield flush()

    return flagged.mapInArrow(
        run, "key long, other long, place long, tag long, mark int")


def _later(windows: DataFrame) -> DataFrame:
    """(place, tag, start) of the windows that are not the first of their sequence."""

    def run(batches):
        last = None  # name of the sequence, and its first place
        for b in batches:
            if b.num_rows == 0:
                continue
            key, other, place, tag, mark = (b.column(i).to_numpy() for i in range(5))
            start, sure = mark >> 1, (mark & 1).astype(bool)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])))
            if last is not None and last[:2] == (int(key[0]), int(other[0])):
                new[0] = False
            # rows that repeat the first row of their sequence are the same window of the same document
            run_no = np.cumsum(new)
            heads = np.flatnonzero(new)
            head = heads[np.maximum(run_no - 1, 0)] if len(heads) else np.zeros(len(key), dtype=np.int64)
            equal = (place == place[head]) & (start == start[head]) & (tag == tag[head]) & (run_no > 0)
            if last is not None:
                held = run_no == 0
                equal[held] = (place[held] == last[2]) & (tag[held] == last[3]) & (start[held] == last[4])
            keep = ~equal | sure
            yield pa.RecordBatch.from_arrays([pa.array(place[keep]), pa.array(tag[keep]), pa.array(start[keep])],
                                             ["place", "tag", "start"])
            if len(heads):
                i = int(heads[-1])
                last = (int(key[i]), int(other[i]), int(place[i]), int(tag[i]), int(start[i]))

    return windows.repartition("key").sortWithinPartitions("key", "other", "place", "tag", "mark").mapInArrow(
        run, "place long, tag long, start int")


def _kept(rows: DataFrame, length: int, keep_text: bool) -> DataFrame:
    def run(batches):
        hasher = BlockHasher()
        for b in batches:
            texts = b.column(1)
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for low, data, offsets in chunks(texts):
                words = hasher.words(data, offsets)
                raw = data.tobytes()
                names = _ids(words)
                for d, (name, tag) in enumerate(zip(names, _tags(names).tolist())):
                    n = int(words.counts[d])
                    parts = raw[offsets[d]:offsets[d + 1]].split()
                    removed = 0
                    for mark in b.column(2)[low + d].as_py() or ():
                        if mark["words"] == name:  # a copy
                            parts, removed = [], n
                        elif mark["tag"] == tag and removed < n:
                            starts = np.array(mark["starts"])
                            step = np.zeros(n + 1, dtype=np.int64)
                            np.add.at(step, starts, 1)
                            np.add.at(step, starts + length, -1)
                            stays = np.cumsum(step[:n]) == 0
                            parts, removed = list(compress(parts, stays.tolist())), int(n - stays.sum())
                    kept = b" ".join(parts)
                    n_words.append(n)
                    n_removed.append(removed)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        kept_texts.append(kept.decode())
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                       pa.array(digests, pa.string())]
            fields = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns, fields = [*columns, pa.array(kept_texts, pa.string())], [*fields, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, fields)

    more = ", kept_text string" if keep_text else ""
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + more)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   cover: tuple[int, ...] = COVER, period: int = PERIOD, keep_text: bool = False) -> DataFrame:
    """One row per row of `documents`: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for)."""
    differences = {(a - b) % period for a in cover for b in cover}
    if len(differences) < period or length < period:
        raise ValueError("cover must give every difference modulo the period, and the period be at most the length")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    place = F.coalesce("doc_id", F.lit(LAST)).alias("place")
    sequences = written(_sequences(texts), "sequences").select(place, "words", "tag", "n")
    firsts = sequences.groupBy("words", "tag").agg(F.min("place").alias("place"))
    found = _repeated(_anchors(texts, length, cover, period)).groupBy("tag").agg(F.collect_list("at").alias("marks"))
    marked = written(found.join(firsts, "tag").select("place", "words", "marks"), "marked")
    flagged = texts.select(place, "text").join(marked, "place").select("place", "words", "text", "marks")
    starts = _later(_windows(flagged, length, period)).groupBy("place", "tag").agg(
        F.collect_list("start").alias("starts"))
    # per id: what happens to each of its texts; texts that keep everything are left out
    copies = sequences.where(F.col("n") >= length).distinct().join(
        firsts.select("words", F.col("place").alias("first")), "words").where("place != first")
    fate = starts.select("place", F.expr("cast(null as binary)").alias("words"), "tag", "starts").unionByName(
        copies.select("place", "words", F.expr("cast(null as long)").alias("tag"),
                      F.expr("cast(null as array<int>)").alias("starts")))
    fates = written(fate.groupBy("place").agg(F.collect_list(F.struct("words", "tag", "starts")).alias("fates")), "fates")
    rows = texts.withColumn("place", place).join(fates, "place", "left").select("doc_id", "text", "fates")
    return _kept(rows, length, keep_text)


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1),
lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t
              FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words) x
              ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)"""
