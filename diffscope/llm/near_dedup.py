"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

1. The set of a document is its distinct word shingles; documents with equal sets are one class.
2. SuperMinHash: for each element of a set a random permutation of the m places of the signature is dealt place by place,
   and the element's rank at a place is its step plus a random fraction. A place keeps the least rank. Ranks of one
   element are correlated (each step occurs once), which lowers the variance of the estimate. All elements of a batch of
   texts go through one step at a time, and a set stops at the first step after which all its places hold ranks of that
   step or earlier ones: long sets after one to three steps.
3. Banding: m places are cut into bands, each a key. Sets that share a key are a list, streamed over sorted keys; each
   list gives the pairs of its members with the least one.
4. Verification on full sets, from whole texts: first the pairs with the least member. Members of a list that are still in
   different groups are then compared with each other, block by block inside tasks; only links that join groups come out.
5. Groups by union-find in tasks and contraction (`operators.components`).

Sets too small to link with any different set (of fewer than p / (q - p) shingles) post no keys. A pair at or above the
threshold t shares no band with probability at most (1 - t^rows)^bands: 3e-8 for 30 bands of 5 at 0.85 and 8e-8 for 43
bands of 4 at 0.75. Nothing else can lose a link; no list, group or text is capped.

Defined cases: null text is empty text, without shingles and linked with nothing; fewer words than n are one shingle;
repeated rows are one class; null ids are kept and name a group only if all ids of it are null; rows with one id are
judged each by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffscope.llm.ngram_join import overlaps, set_id, shingles
from diffscope.llm.store import Files, shared_folder, written
from diffscope.llm.words import BlockHasher, mixed, signed
from diffscope.operators.components import connected

BANDS, ROWS = 30, 5
FILTER_BITS = 1 << 29  # membership filter: 64 MB in each worker at most; beyond that it lets more texts pass
LOW = np.uint64(32)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (one row of m ranks per non-empty set): step in the upper, fraction in the lower half of 64 bits."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(sets):
        return out
    x, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = None  # what is left of each element's permutation, from the second step on
    for step in range(m):
        u = mixed(x, 1000 + step)
        spot = step + ((u & np.uint64(0xFFFFFFFF)) * np.uint64(m - step) >> LOW).astype(np.int64)
        if order is None:
            place = spot
        else:
            at = np.arange(len(x))
            place = order[at, spot].astype(np.int64)
            order[at, spot] = order[:, step]
        np.minimum.at(out.reshape(-1), row * m + place, (np.uint64(step) << LOW) | (u >> LOW))
        open_sets = (out >= np.uint64(step + 1) << LOW).any(axis=1)
        if not open_sets.any():
            break
        keep = open_sets[row]
        if order is None:
            x, row, spot = x[keep], row[keep], spot[keep]
            order = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(x), 1))
            order[np.arange(len(x)), spot] = 0
        elif keep.mean() < 0.7:
            x, row, order = x[keep], row[keep], order[keep]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per set and band; keys of different bands differ."""
    parts = mixed(signatures.reshape(-1, bands, rows) + np.arange(rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(parts.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x94D049BB133111EB), 7)


def _signed_sets(documents: DataFrame, id_col: str, text_col: str, n: int, threshold: tuple[int, int], bands: int,
                 rows: int) -> DataFrame:
    """(doc_id, tag, n, set, keys) of each document; keys only for the first of equal sets in a task."""
    p, q = threshold

    def run(batches):
        hasher, seen = BlockHasher(fold=True), set()
        for b in batches:
            sizes, ids, fresh, held, elements, made = [], [], [], [], 0, []

            def sign():
                if held:
                    made.append(band_keys(super_minhash(held, bands * rows), bands, rows))
                held.clear()

            for s in shingles(hasher, b.column(2), n):
                name = set_id(s)
                sizes.append(len(s))
                ids.append(name)
                fresh.append(len(s) * (q - p) >= p and name not in seen)
                if fresh[-1]:
                    seen.add(name)
                    held.append(s)
                    elements += len(s)
                    if elements > 200_000:
                        sign()
                        elements = 0
            sign()
            flat = np.concatenate(made).reshape(-1) if made else np.zeros(0, dtype=np.uint64)
            ends = np.concatenate(([0], np.cumsum(fresh))) * bands
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(flat)))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), keys],
                                             ["doc_id", "tag", "n", "set", "keys"])

    kind = documents.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    return documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, tag long, n long, set binary, keys array<long>")


def _pairs(sets: DataFrame) -> DataFrame:
    """Distinct (u, n, centre, m): sets with the least set that shares a key with them, and both sizes."""
    names = ["u", "n", "centre", "m"]

    def run(batches):
        key_before = centre = size = None
        for b in batches:
            if not b.num_rows:
                continue
            key, ids, n = b.column(0).to_numpy(), b.column(1), b.column(2)
            first = np.concatenate(([key_before is None or key[0] != key_before], key[1:] != key[:-1]))
            heads = np.flatnonzero(first)
            centres, sizes = ids.take(pa.array(heads)), n.take(pa.array(heads))
            if not first[0]:  # the list of the batch before goes on
                centres = pa.concat_arrays([pa.array([centre], pa.binary()), centres])
                sizes = pa.concat_arrays([pa.array([size], pa.int64()), sizes])
            run_no = np.cumsum(first) - int(first[0])
            key_before, centre, size = key[-1], centres[len(centres) - 1].as_py(), sizes[len(sizes) - 1].as_py()
            both = pa.chunked_array([pa.concat_arrays([ids, centres])]).dictionary_encode().combine_chunks().indices.to_numpy()
            keep = both[:len(ids)] != both[len(ids):][run_no]
            at = pa.array(run_no)
            yield pa.RecordBatch.from_arrays([ids, n, centres.take(at), sizes.take(at)], names).filter(pa.array(keep))

    posted = sets.where("size(keys) > 0").select(F.explode("keys").alias("key"), "set", "n")
    return posted.repartition("key").sortWithinPartitions("key", "set").mapInArrow(
        run, "u binary, n long, centre binary, m long").distinct()


def _members(documents: DataFrame, id_col: str, text_col: str, chosen: DataFrame) -> DataFrame:
    """(set, text) for the sets of `chosen` (set, doc_id, tag), through a membership filter that each task loads."""
    spark = documents.sparkSession
    spots = [F.pmod(F.xxhash64(F.lit(i), "tag"), F.lit(1 << 40)) for i in (1, 2)]
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * max(1, chosen.count()) - 1).bit_length()))
    words = chosen.select(F.explode(F.array(*spots)).alias("spot")).select((F.col("spot") % bits).alias("bit")).select(
        F.expr("bit div 64").alias("word"), (F.col("bit") % 64).cast("int").alias("place")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("value"))
    folder = shared_folder(spark, "near-filter")
    files = Files(folder)
    files.make()
    table = np.zeros(bits // 64, dtype=np.uint64)
    for word, value in words.toLocalIterator(prefetchPartitions=False):  # at most FILTER_BITS / 64 rows
        table[word] = np.uint64(value & (2**64 - 1))
    files.write("bits", table.tobytes())

    def some(batches):
        held, seen = np.frombuffer(Files(folder).read("bits"), dtype=np.uint64), set()
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for i in (3, 4):
                bit = b.column(i).to_numpy() % bits
                keep &= (held[bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            for i in np.flatnonzero(keep).tolist():  # repeated rows pass once a task
                row = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                keep[i] = row not in seen
                seen.add(row)
            yield pa.RecordBatch.from_arrays(b.columns[:3], ["doc_id", "tag", "text"]).filter(pa.array(keep))

    kind = documents.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    passed = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")).select(
        "doc_id", "tag", "text", *spots).toDF("doc_id", "tag", "text", "s1", "s2").mapInArrow(
        some, f"doc_id {kind}, tag long, text string")
    want = chosen.select("set", F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    return passed.join(want, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        "set", "text").dropDuplicates(["set"])


def _linked(pairs: DataFrame, members: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Of the pairs (u, v) those whose full sets reach the threshold."""
    p, q = threshold

    def run(batches):
        hasher, name, other = BlockHasher(fold=True), None, None
        for b in batches:
            keep = []
            names = b.column(1).to_pylist()
            fresh = [i for i, v in enumerate(names) if v != (names[i - 1] if i else name)]
            right = shingles(hasher, b.column(3).take(pa.array(fresh, pa.int64())), n)
            starts = set(fresh)
            for i, s in enumerate(shingles(hasher, b.column(2), n)):
                if i in starts:
                    name, other = names[i], next(right)
                both = len(np.intersect1d(s, other, assume_unique=True))
                keep.append(q * both >= p * (len(s) + len(other) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = [members.select(F.col("set").alias(c), F.col("text").alias(f"{c}_text")) for c in ("u", "v")]
    return pairs.join(texts[0], "u").join(texts[1], "v").select("u", "v", "u_text", "v_text").mapInArrow(
        run, "u binary, v binary")


def _rest(apart: DataFrame, members: DataFrame, n: int, threshold: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """Links (u, v) that join different groups c among the sets of each centre (rows centre, u, n, c).

    A centre's sets are cut into blocks of about `block` members and shingles, and each pair of blocks is a unit of work.
    Units are numbered and dealt in turn, so no task has more than its share of them.
    """
    p, q = threshold
    most, room = block
    blocks = apart.groupBy("centre").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / room)).cast("int").alias("blocks"))
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    units = written(blocks.select("centre", "blocks", F.explode(numbers).alias("a")).select(
        "centre", "blocks", "a", F.explode(F.sequence("a", F.col("blocks") - 1)).alias("b")).withColumn(
        "unit", F.monotonically_increasing_id()), "near-units")
    mine = F.pmod(F.xxhash64("u", F.lit(3)), F.col("blocks")).cast("int")
    placed = apart.join(blocks, "centre").select("centre", F.col("u").alias("set"), "c", mine.alias("mine"), F.explode(
        numbers).alias("other")).select("centre", "set", "c", "mine", F.least("mine", "other").alias("a"),
                                        F.greatest("mine", "other").alias("b"))
    parts = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.join(units.drop("blocks"), ["centre", "a", "b"]).join(members, "set").withColumn(
        "part", F.pmod("unit", F.lit(parts)).cast("int")).repartitionById(parts, F.col("part")).sortWithinPartitions(
        "unit", "set").select("unit", "set", "c", (F.col("mine") == F.col("a")).alias("left"),
                              (F.col("a") == F.col("b")).alias("alone"), "text")

    def solve(held, alone):
        left = [r for r in held if alone or r[2]]
        right = left if alone else [r for r in held if not r[2]]
        if not left or not right or len({r[1] for r in held}) < 2:
            return None
        size = [np.array([len(r[3]) for r in side], dtype=np.float64) for side in (left, right)]
        colour = {c: i for i, c in enumerate({r[1] for r in held})}
        group = [np.array([colour[r[1]] for r in side]) for side in (left, right)]
        both = overlaps([r[3] for r in left], [r[3] for r in right])
        near = q * both >= p * (size[0][:, None] + size[1][None, :] - both)
        at = np.argwhere(near & (group[0][:, None] != group[1][None, :]))
        # one link of each pair of groups will do: members of one group are linked already
        _, first = np.unique(group[0][at[:, 0]] * len(colour) + group[1][at[:, 1]], return_index=True)
        found = [(left[i][0], right[j][0]) for i, j in at[first].tolist()]
        u, v = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    def run(batches):
        hasher, unit, held, alone = BlockHasher(fold=True), None, [], False
        for b in batches:
            at, names, c, side, same = (b.column(i).to_pylist() for i in range(5))
            for i, s in enumerate(shingles(hasher, b.column(5), n)):
                if at[i] != unit:
                    if held and (out := solve(held, alone)) is not None:
                        yield out
                    unit, held, alone = at[i], [], same[i]
                held.append((names[i], c[i], side[i], s))
        if held and (out := solve(held, alone)) is not None:
            yield out

    return rows.mapInArrow(run, "u binary, v binary")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    threshold: tuple[int, int] = (75, 100), bands: int = 43, rows: int = 4,
                    block: tuple[int, int] = (512, 200_000)) -> DataFrame:
    """One row per row of `documents`: doc_id, tag (xxhash64 of the text), n_shingles, root (the set that names the group,
    null without shingles), component_id (least id of the group) and kept (doc_id is component_id).

    `bands` and `rows` trade work for the odds of missing a pair (above); `block` moves work, not results.
    """
    sets = written(_signed_sets(documents, id_col, text_col, n, threshold, bands, rows), "near-sets")
    pairs = written(_pairs(sets), "near-pairs")
    involved = pairs.select(F.col("u").alias("set")).unionByName(pairs.select(F.col("centre").alias("set"))).distinct()
    classes = sets.where("n > 0").groupBy("set").agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "tag")).alias("one"))
    chosen = written(classes.join(involved, "set", "left_semi").select("set", "one.doc_id", "one.tag"), "near-involved")
    members = written(_members(documents, id_col, text_col, chosen), "near-members")

    p, q = threshold
    near = F.least("n", "m") * q >= F.greatest("n", "m") * p
    links = written(_linked(pairs.where(near).select("u", F.col("centre").alias("v")), members, n, threshold), "near-links")
    roots = written(connected(links, lambda df: written(df, "near-groups")), "near-roots")

    # of the sets that share a centre, those that are not in one group yet
    labelled = written(pairs.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").select(
        "centre", "u", "n", F.coalesce("root", "u").alias("c")), "near-labelled")
    several = labelled.groupBy("centre").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    apart = written(labelled.join(several, "centre", "left_semi"), "near-apart")
    more = written(_rest(apart, members, n, threshold, block), "near-more")
    if not more.isEmpty():
        roots = written(connected(links.unionByName(more), lambda df: written(df, "near-groups")), "near-roots")

    named = classes.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select(
        "set", "class_id", F.coalesce("root", "set").alias("root"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    final = named.join(least, "root").select("set", "component_id", "root")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.drop("keys").join(final, "set", "left").select(
        "doc_id", "tag", F.col("n").alias("n_shingles"), "root", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN
         list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
             FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
          WHERE 100 * k >= 85 * (x.n + y.n - k)),
reached AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION
            SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v),
names AS (SELECT u AS doc_id, min(v) AS component_id FROM reached GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN names USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
