"""Jaccard self-join of word n-gram sets and its components: size-aware, with a light and a heavy path.

1. Documents with equal sets form a class; only classes go on, so a group of copies costs one class.
2. Light classes (at most x shingles) post fixed-size subsets: two sets of sizes a <= b that reach the threshold share
   at least c(a) = ceil(2ta / (1 + t)) shingles, so they share a subset of that size. Heavy classes post their prefix, the
   n - ceil(tn) + 1 shingles that are rarest in the corpus, and light ones near the boundary post it as well, to be
   met by heavy ones. x is the size at which the estimated rows and list scans are fewest (`boundary`).
3. Postings are dealt by key and sorted; keys with one class vanish in a streaming pass. What is left are the inverted
   lists: every pair that reaches the threshold is in one of them.
4. Links are verified on whole texts. A list is first joined as a star around its least member, so a group of near copies
   costs its size, not its square. Lists of three or more whose members are not in one component then are cut into
   blocks, and the overlaps of all their members computed block by block inside tasks; only links that join components
   come out. No pair is left out, so the components are exact.
5. Where the number of links is asked for (`links`), all pairs of all lists are verified in this way instead, each in one
   place only: in the least of the centres that both sets have. Pairs whose sizes and bitmaps (`parity`) rule a link out
   need no texts, so only sets with another pair are read again. Links are counted, not emitted; a spanning forest comes out.

Rarity is a count over all documents in a fixed number of hash cells. It only orders the shingles: whatever its
precision, results are the same. Defined cases: null text is empty text, without shingles and linked with nothing;
fewer words than n are one shingle; repeated rows are one class; null ids are kept and never name a component unless
all ids of it are null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffscope.llm.store import Files, shared_folder, written
from diffscope.llm.words import BlockHasher, chunks, mixed, signed

LARGEST_LIGHT = 16  # sizes considered for the boundary: subsets of larger sets are too many to be the cheaper way
CELL_BITS = (16, 26)  # least and most bits of the rarity table: 64 KB to 64 MB in each worker
BLOCK_BITS = 16
HELD_CELLS = 4_000_000  # shingles a task holds before it sends their cells: 16 MB
SALTS = 16
FILTER_BITS = 1 << 29  # 64 MB in each worker
FEW_PAIRS = 200  # pairs of bitmaps that are compared one by one
COMPARED = 1 << 18  # words of bitmaps compared at once: 2 MB


def needed(size: int, threshold: tuple[int, int]) -> int:
    """Least overlap of a set with any set it reaches the threshold with."""
    p, q = threshold
    return -(-p * size // q)


def subset_size(size: int, threshold: tuple[int, int]) -> int:
    """Least overlap of a set of this size with a set at least as large."""
    p, q = threshold
    return -(-2 * p * size // (p + q))


def prefix_size(size: int, threshold: tuple[int, int]) -> int:
    return size - needed(size, threshold) + 1


def light_rows(size: int, threshold: tuple[int, int]) -> int:
    return sum(math.comb(size, subset_size(a, threshold)) for a in range(needed(size, threshold), size + 1))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a sort, which is faster here than the hash table of `np.unique`."""
    x = np.sort(x)
    first = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingles(hasher: BlockHasher, texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for _, data, offsets in chunks(texts):
        words = hasher.words(data, offsets)
        at, h = hasher.grams(words, n)
        cut = np.searchsorted(at, words.first)
        short = {k: hasher.grams(words, k) for k in set(words.counts.tolist()) if 0 < k < n}
        for d, count in enumerate(words.counts.tolist()):
            if count >= n:
                yield distinct(h[cut[d]:cut[d + 1]])
            elif count:
                where, whole = short[count]
                yield whole[np.searchsorted(where, words.first[d])][None]
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity(s: np.ndarray) -> bytes:
    """Bitmap of a set: each bit tells whether an odd number of its shingles fall on it.

    The length is the least power of two from 64 that is no less than the size. Each shingle that only one of two sets has
    changes one bit, so no more bits differ than there are such shingles; halves may be added to compare with a shorter one.
    """
    size = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def maybe_linked(sizes: tuple[np.ndarray, np.ndarray], maps: tuple[list[bytes], list[bytes]],
                 threshold: tuple[int, int]) -> np.ndarray:
    """Pairs of two lists of sets that sizes and bitmaps do not rule out; every pair that reaches the threshold is one.

    Sets of a and b shingles that reach p/q differ in at most (q - p)(a + b) / (q + p) shingles.
    """
    p, q = threshold
    a, b = sizes[0][:, None], sizes[1][None, :]
    found = q * np.minimum(a, b) >= p * np.maximum(a, b)
    pairs = np.argwhere(found)
    if len(pairs) <= FEW_PAIRS:
        whole = [[(int.from_bytes(x, "little"), 8 * len(x)) for x in side] for side in maps]
        for i, j in pairs.tolist():
            (x, k), (y, m) = whole[0][i], whole[1][j]
            while k > m:
                k //= 2
                x = x >> k ^ x & (1 << k) - 1
            while m > k:
                m //= 2
                y = y >> m ^ y & (1 << m) - 1
            found[i, j] = (p + q) * (x ^ y).bit_count() <= (q - p) * int(a[i, 0] + b[0, j])
        return found

    def by_length(side: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        length = np.array([len(x) // 8 for x in side])
        return {int(k): (at := np.flatnonzero(length == k), np.frombuffer(
            b"".join([side[i] for i in at]), dtype="<u8").reshape(len(at), -1)) for k in np.unique(length)}

    def folded(rows: np.ndarray, length: int) -> np.ndarray:
        while rows.shape[1] > length:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    left, right = (by_length(side) for side in maps)
    for k, (i, x) in left.items():
        for m, (j, y) in right.items():
            if not found[np.ix_(i, j)].any():
                continue
            one, two = folded(x, min(k, m)), folded(y, min(k, m))
            step = max(1, COMPARED // two.size)
            for low in range(0, len(i), step):
                part = i[low:low + step]
                differ = np.bitwise_count(one[low:low + step, None] ^ two[None]).sum(axis=2, dtype=np.int64)
                found[np.ix_(part, j)] &= (p + q) * differ <= (q - p) * (sizes[0][part][:, None] + sizes[1][j][None, :])
    return found


def _sets(documents: DataFrame, id_col: str, text_col: str, n: int, maps: bool = False) -> DataFrame:
    """(doc_id, tag, n, set): the size of each document's set and the digest that names it; tag is a hash of the text.

    With `maps` also the bitmap of the set.
    """

    def run(batches):
        hasher = BlockHasher(fold=True)
        for b in batches:
            sizes, ids, bits = [], [], []
            for s in shingles(hasher, b.column(2), n):
                sizes.append(len(s))
                ids.append(set_id(s))
                if maps:
                    bits.append(parity(s))
            more = [pa.array(bits, pa.binary())] if maps else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), *more],
                ["doc_id", "tag", "n", "set", "bits"][:4 + maps])

    kind = documents.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    return documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, tag long, n long, set binary" + (", bits binary" if maps else ""))


def _rarity(texts: DataFrame, n: int, total: int) -> tuple[str, float]:
    """Folder of the table of cell counts (as logarithms), and the mean length of the list of a posting."""
    low, high = CELL_BITS
    bits = min(high, max(low, round(math.log2(max(total, 1) / 32))))
    shift, blocks = np.uint64(64 - bits), 1 << (bits - BLOCK_BITS)

    def count(batches):
        hasher, seen, held, size = BlockHasher(fold=True), set(), [], 0
        salt = TaskContext.get().partitionId() % SALTS

        def sent():
            """Cells that are not empty, by block: their low bits and counts."""
            cells = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            counts = np.diff(np.append(first, len(cells))).astype(np.uint32)
            cells = cells[first]
            edges = np.searchsorted(cells >> BLOCK_BITS, np.arange(blocks + 1))
            some = [(i, low, high) for i, (low, high) in enumerate(zip(edges, edges[1:])) if low < high]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in some]), pa.array([salt] * len(some)),
                 pa.array([cells[low:high].astype(np.uint16).tobytes() for _, low, high in some]),
                 pa.array([counts[low:high].tobytes() for _, low, high in some])], ["block", "salt", "cells", "counts"])

        for b in batches:
            for s in shingles(hasher, b.column(0), n):
                if len(s) and (key := set_id(s)) not in seen:
                    seen.add(key)
                    held.append((s >> shift).astype(np.uint32))
                    size += len(s)
                    if size >= HELD_CELLS:
                        yield sent()
                        held, size = [], 0
        if held:
            yield sent()

    def summed(batches):
        """(block, salt, counts of its cells) of rows sorted by block and salt: one block is held at a time."""
        at, cells = None, np.zeros(1 << BLOCK_BITS, dtype=np.uint64)
        for b in batches:
            for block, salt, places, counts in zip(*(c.to_pylist() for c in b.columns)):
                if (block, salt) != at:
                    if at is not None:
                        yield *at, cells
                    at = block, salt
                    cells[:] = 0
                cells[np.frombuffer(places, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.uint32)
        if at is not None:
            yield *at, cells

    def add(batches):
        for block, salt, cells in summed(batches):
            places = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([salt]), pa.array([places.astype(np.uint16).tobytes()]),
                 pa.array([np.minimum(cells[places], 2**32 - 1).astype(np.uint32).tobytes()])],
                ["block", "salt", "cells", "counts"])

    def rank(batches):
        for block, _, cells in summed(batches):
            part = cells.astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([np.rint(4 * np.log2(part + 1)).astype(np.uint8).tobytes()]),
                 pa.array([part.sum()]), pa.array([(part * part).sum()])], ["block", "ranks", "ones", "twos"])

    schema = "block long, salt long, cells binary, counts binary"
    parts = texts.select("text").mapInArrow(count, schema).repartition("block", "salt").sortWithinPartitions(
        "block", "salt").mapInArrow(add, schema)
    found = parts.withColumn("salt", F.lit(0).cast("long")).repartition("block").sortWithinPartitions("block").mapInArrow(
        rank, "block long, ranks binary, ones double, twos double").collect()  # a table of at most 2^26 bytes
    table = np.zeros((blocks, 1 << BLOCK_BITS), dtype=np.uint8)
    for row in found:
        table[row.block] = np.frombuffer(row.ranks, dtype=np.uint8)
    folder = shared_folder(texts.sparkSession, "shingle-rarity")
    files = Files(folder)
    files.make()
    files.write("ranks", table.tobytes())
    return folder, sum(r.twos for r in found) / max(1.0, sum(r.ones for r in found))


def boundary(counts: dict[int, int], mean_list: float, threshold: tuple[int, int]) -> int:
    """Largest light size: fewest subset rows, and list scans of what posts prefixes."""

    def cost(x: int) -> float:
        total = 0.0
        for size, count in counts.items():
            scan = prefix_size(size, threshold) * (1 + mean_list)
            if size <= x:
                total += count * light_rows(size, threshold)
            if size > x or size >= needed(x + 1, threshold):
                total += count * scan
        return total

    return min(range(LARGEST_LIGHT + 1), key=cost)


def _postings(texts: DataFrame, n: int, threshold: tuple[int, int], folder: str, x: int) -> DataFrame:
    """(key, set, n): subset keys of light sets, prefix shingles of the others. Copies inside a task post once."""

    def run(batches):
        hasher, seen = BlockHasher(fold=True), set()
        ranks = np.frombuffer(Files(folder).read("ranks"), dtype=np.uint8)
        shift = np.uint64(64 - int(math.log2(len(ranks))))
        chosen: dict[tuple[int, int], np.ndarray] = {}
        reach = needed(x + 1, threshold)

        def keys(s: np.ndarray) -> np.ndarray:
            size, found = len(s), []
            if size <= x:
                for a in range(needed(size, threshold), size + 1):
                    c = subset_size(a, threshold)
                    if (size, c) not in chosen:
                        chosen[size, c] = np.array(list(combinations(range(size), c)), dtype=np.int64)
                    found.append(mixed(mixed(s, 5)[chosen[size, c]].sum(axis=1, dtype=np.uint64), 100 + a))
            if size > x or size >= reach:
                order = np.argsort(ranks[(s >> shift).astype(np.int64)], kind="stable")
                found.append(s[order[:prefix_size(size, threshold)]])
            return np.concatenate(found)

        for b in batches:
            out, ids, sizes, lengths, held = [], [], [], [], 0
            for s in shingles(hasher, b.column(0), n):
                if len(s) == 0 or (name := set_id(s)) in seen:
                    continue
                seen.add(name)
                k = keys(s)
                out.append(k)
                ids.append(name)
                sizes.append(len(s))
                lengths.append(len(k))
                held += len(k)
                if held >= 200_000:
                    yield _rows(out, ids, sizes, lengths)
                    out, ids, sizes, lengths, held = [], [], [], [], 0
            if out:
                yield _rows(out, ids, sizes, lengths)

    def _rows(out, ids, sizes, lengths):
        pick = pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), lengths))
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(np.concatenate(out))), pa.array(ids, pa.binary()).take(pick),
             pa.array(np.repeat(np.array(sizes, dtype=np.int64), lengths))], ["key", "set", "n"])

    return texts.select("text").mapInArrow(run, "key long, set binary, n long")


def _lists(postings: DataFrame) -> DataFrame:
    """Postings of the keys that two different sets share, with the first set of the list (centre, of m shingles).

    `more` is false for a list that is known to have two members only. Streams over sorted rows, whatever a key's length.
    Most keys have one row: these go before Python sees them, and only the others are sorted by set as well.
    """
    names = ["key", "set", "n", "centre", "m", "more"]

    def run(batches):
        last = None  # the row before: key, set; centre of its key and its size; whether the centre was sent
        for b in batches:
            if b.num_rows == 0:
                continue
            key, ids, n = b.column(0).to_numpy(), b.column(1), b.column(2)
            codes = ids.dictionary_encode().indices.to_numpy()
            first = np.concatenate(([True], key[1:] != key[:-1]))
            again = np.concatenate(([False], (key[1:] == key[:-1]) & (codes[1:] == codes[:-1])))
            joins = last is not None and last[0] == key[0]
            if joins:
                first[0] = False
                again[0] = last[1] == ids[0].as_py()
            run_no = np.cumsum(first)
            heads = np.concatenate(([0], np.flatnonzero(first)))
            members = np.bincount(run_no, weights=~again, minlength=run_no[-1] + 1)
            if joins:
                if not last[4] and members[0] > 0:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([last[0]]), pa.array([last[2]], pa.binary()), pa.array([last[3]]),
                         pa.array([last[2]], pa.binary()), pa.array([last[3]]), pa.array([True])], names)
                members[0] += 2 if last[4] else 1
            centres, sizes = ids.take(pa.array(heads)), n.take(pa.array(heads))
            if joins:
                centres = pa.concat_arrays([pa.array([last[2]], pa.binary()), centres[1:]])
                sizes = pa.concat_arrays([pa.array([last[3]]), sizes[1:]])
            keep = pa.array(~again & (members[run_no] > 1))
            at = pa.array(run_no)
            more = members > 2
            more[-1] = True  # the last list may go on
            more[0] |= joins
            yield pa.RecordBatch.from_arrays([*b.columns, centres.take(at), sizes.take(at), pa.array(more[run_no])],
                                             names).filter(keep)
            end = int(run_no[-1])
            last = (int(key[-1]), ids[len(ids) - 1].as_py(), centres[end].as_py(), sizes[end].as_py(),
                    bool(members[end] > 1))

    some = postings.repartition("key").withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return some.where("rows > 1").drop("rows").sortWithinPartitions("key", "set").mapInArrow(
        run, "key long, set binary, n long, centre binary, m long, more boolean")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs of sets (u, v) those that reach the threshold, by their whole shingle sets."""
    p, q = threshold

    def run(batches):
        hasher = BlockHasher(fold=True)
        for b in batches:
            keep, held = [], (None, None)
            left = shingles(hasher, b.column(2), n)
            names, other = b.column(1).to_pylist(), b.column(3)
            changed = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
            right = shingles(hasher, other.take(pa.array(changed, pa.int64())), n)
            starts = set(changed)
            for i, s in enumerate(left):
                if i in starts:
                    held = next(right)
                both = len(np.intersect1d(s, held, assume_unique=True))
                keep.append(q * both >= p * (len(s) + len(held) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("set").alias("u"), F.col("text").alias("u_text")), "u").join(
        texts.select(F.col("set").alias("v"), F.col("text").alias("v_text")), "v")
    return joined.select("u", "v", "u_text", "v_text").mapInArrow(run, "u binary, v binary")


def _rest(groups: DataFrame, members: DataFrame, n: int, threshold: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """Links (u, v) that join the components c within each group (rows centre, set, n, c).

    A group is cut into blocks of about `block` members and shingles, and each pair of blocks is a task's unit, so none is
    larger than two blocks. Inside, all overlaps come from products of the member-by-shingle matrix; per component of
    the result one star of links is returned, never all pairs.
    """
    p, q = threshold
    most, room = block
    sizes = groups.groupBy("centre").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"),
                                         F.min(F.xxhash64("c")).alias("low"), F.max(F.xxhash64("c")).alias("high"))
    sizes = sizes.where("low != high").select("centre", F.greatest(
        F.ceil(F.col("k") / most), F.ceil(F.col("total") / room)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("set", F.lit(3)), F.col("blocks")).cast("int")
    placed = groups.join(sizes, "centre").select("centre", "set", "c", mine.alias("mine"), F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "set", "c", "mine", F.xxhash64("centre", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"),
        (F.col("mine") == F.col("other")).alias("alone"))
    rows = placed.join(members, "set").repartition("unit").sortWithinPartitions("unit", "set").select(
        "unit", "set", "c", "mine", "alone", "text")

    def run(batches):
        hasher, unit, held = BlockHasher(fold=True), None, []

        def solve():
            if len({r[1] for r in held}) < 2 or (len({r[2] for r in held}) == 1 and not held[0][3]):
                return None
            sets = [r[4] for r in held]
            count = np.array([len(s) for s in sets], dtype=np.float64)
            different, column = np.unique(np.concatenate(sets), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), count.astype(np.int64))
            shared = np.bincount(column) > 1
            keep = shared[column]
            row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            both = np.zeros((len(sets), len(sets)), dtype=np.float32)
            for low in range(0, int(shared.sum()), 2048):
                a, z = np.searchsorted(column, (low, low + 2048))
                part = np.zeros((len(sets), 2048), dtype=np.float32)
                part[row[a:z], column[a:z] - low] = 1
                both += part @ part.T
            linked = q * both >= p * (count[:, None] + count[None, :] - both)
            colour = {c: i for i, c in enumerate({r[1] for r in held})}
            group = np.array([colour[r[1]] for r in held])
            pairs = np.argwhere(linked & (group[:, None] != group[None, :]))
            found, root = [], list(range(len(colour)))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in pairs.tolist():
                x, y = find(int(group[i])), find(int(group[j]))
                if x != y:
                    root[x] = y
                    found.append((held[i][0], held[j][0]))
            # members of one component may be apart here: they are linked by what made the component
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

        for b in batches:
            units, names, c, mine, alone = (b.column(i).to_pylist() for i in range(5))
            for at, name, comp, block_no, self_pair, s in zip(units, names, c, mine, alone, shingles(hasher, b.column(5), n)):
                if at != unit:
                    if held and (out := solve()) is not None:
                        yield out
                    unit, held = at, []
                held.append((name, comp, block_no, self_pair, s))
        if held and (out := solve()) is not None:
            yield out

    return rows.mapInArrow(run, "u binary, v binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of the sets of `left` with those of `right`."""
    a, b = np.concatenate(left), np.concatenate(right)
    values = np.intersect1d(distinct(a), distinct(b), assume_unique=True)
    both = np.zeros((len(left), len(right)), dtype=np.float32)

    def cells(sets, flat):
        column = np.searchsorted(values, flat)
        keep = column < len(values)
        keep[keep] = values[column[keep]] == flat[keep]
        row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep], column[keep]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    sides = [(left, *cells(left, a)), (right, *cells(right, b))]
    for low in range(0, len(values), 2048):
        parts = []
        for sets, row, column in sides:
            i, j = np.searchsorted(column, (low, low + 2048))
            part = np.zeros((len(sets), min(2048, len(values) - low)), dtype=np.float32)
            part[row[i:j], column[i:j] - low] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both


def _dealt(groups: DataFrame, block: tuple[int, int]) -> DataFrame:
    """(g, a, b, mine, set): groups (rows g, set, n) cut into blocks of about `block` members and shingles.

    Each pair of blocks a <= b is a unit; a member is in each unit of its own block `mine`.
    """
    most, room = block
    large = groups.groupBy("g").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / room)).cast("int").alias("blocks")).where("blocks > 1")
    cut = groups.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("set", F.lit(3)), F.col("blocks")).cast("int")
    return cut.select("g", "set", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "g", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "set")


def _units(rows: DataFrame, kept: str, solve, schema: str) -> DataFrame:
    """What `solve` makes of each unit of rows (g, a, b, mine and the columns `kept`), from its two sides (twice the same
    where a = b). A side has a list for each column of `kept`."""

    def run(batches):
        unit, held = None, []

        def solved():
            g, a, b = unit
            left = [list(c) for c in zip(*(r[1:] for r in held if r[0] == a))]
            right = left if a == b else [list(c) for c in zip(*(r[1:] for r in held if r[0] == b))]
            return solve(g, a == b, left, right) if left and right and len(held) > 1 else None

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for at, r in zip(zip(*columns[:3]), zip(*columns[3:])):
                if at != unit:
                    if held and (out := solved()) is not None:
                        yield out
                    unit, held = at, []
                held.append(r)
        if held and (out := solved()) is not None:
            yield out

    return rows.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "set").select(
        "g", "a", "b", "mine", *kept.split()).mapInArrow(run, schema)


def _first_here(g: int, left: list, right: list) -> np.ndarray:
    """Pairs that have no group in common before g, from all groups of each member."""
    before = [[(x := np.array(all_, dtype=np.int64))[x < g] for all_ in side] for side in (left, right)]
    return overlaps(*before) == 0


def _possible(groups: DataFrame, sets: DataFrame, threshold: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """Those of the groups' rows (g, set, n) whose set may be linked, by sizes and bitmaps, with one that it meets first in g.

    No text is read, and a bitmap has about a bit for each shingle, so blocks are larger than those of texts.
    """
    most, room = block

    def solve(g, alone, left, right):
        (names, n, all_, maps), (names_, n_, all_2, maps_) = left, right
        some = maybe_linked((np.array(n), np.array(n_)), (maps, maps_), threshold)
        if alone:
            np.fill_diagonal(some, False)
        if some.any():
            some &= _first_here(g, all_, all_2)
        keep = [(names[i], n[i]) for i in np.flatnonzero(some.any(axis=1))]
        if not alone:
            keep += [(names_[i], n_[i]) for i in np.flatnonzero(some.any(axis=0))]
        if not keep:
            return None
        found, counts = zip(*keep)
        return pa.RecordBatch.from_arrays(
            [pa.array([g] * len(keep)), pa.array(found, pa.binary()), pa.array(counts, pa.int64())], ["g", "set", "n"])

    rows = _dealt(groups, (4 * most, 64 * room)).join(sets, "set")
    return _units(rows, "set n all bits", solve, "g long, set binary, n long").distinct()


def _counted(groups: DataFrame, sets: DataFrame, members: DataFrame, threshold: tuple[int, int],
             block: tuple[int, int]) -> DataFrame:
    """All links within groups: (u, v) of a spanning forest, and (u, null, linked) with the documents linked with set u.

    Groups are cut into blocks as in `_rest`. A pair may be in several groups and counts in the first of them; all groups
    of a set, no more than its keys, come along with it.
    """
    p, q = threshold

    def solve(g, alone, left, right):
        (names, all_, copies, held), (names_, all_2, copies_, held_) = left, right
        one, two = ([np.frombuffer(s, dtype=np.uint64) for s in side] for side in (held, held_))
        size = [np.array([len(s) for s in side], dtype=np.float64) for side in (one, two)]
        both = overlaps(one, two)
        linked = q * both >= p * (size[0][:, None] + size[1][None, :] - both)
        if alone:
            linked = np.triu(linked, 1)
        if linked.any():
            linked &= _first_here(g, all_, all_2)
        if not linked.any():
            return None
        weight = [np.array(x, dtype=np.int64) for x in (copies, copies_)]
        found: dict[bytes, int] = {}
        for side, counts in ((names, linked @ weight[1]), (names_, linked.T @ weight[0])):
            for name, count in zip(side, counts.tolist()):
                if count:
                    found[name] = found.get(name, 0) + count
        if alone:
            nodes, near = names, linked | linked.T
        else:
            nodes, k = names + names_, len(names)
            near = np.zeros((len(nodes), len(nodes)), dtype=bool)
            near[:k, k:], near[k:, :k] = linked, linked.T
        u, v, open_ = [], [], near.any(axis=1)
        while open_.any():
            start = int(np.argmax(open_))
            open_[start], ahead = False, [start]
            while ahead:
                i = ahead.pop()
                new = np.flatnonzero(near[i] & open_)
                open_[new] = False
                u += [nodes[i]] * len(new)
                v += [nodes[j] for j in new.tolist()]
                ahead += new.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([*u, *found], pa.binary()), pa.array([*v, *[None] * len(found)], pa.binary()),
             pa.array([*[None] * len(u), *found.values()], pa.int64())], ["u", "v", "linked"])

    rows = _dealt(groups, block).join(sets, "set").join(members, "set")
    return _units(rows, "set all copies shingles", solve, "u binary, v binary, linked long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for the nodes of the undirected edges (u, v); root is the least node. Alternating star steps.

    Every step is one minimum per node (combined before the shuffle) and one join, so a hub is no single task.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(now)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        after = state(now)
        if after == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = after
    raise RuntimeError("components did not settle")


def _members(texts: DataFrame, lists: DataFrame, classes: DataFrame, n: int, whole: bool = True) -> DataFrame:
    """(set, text): one text of each set that is in a list. Unless `whole`, (set, shingles): its sorted shingle hashes.

    A filter of at most `FILTER_BITS` bits keeps most other texts out of the shuffle; beyond that size it lets more pass.
    """
    involved = written(lists.select("set").distinct().join(classes, "set").select("set", "class_id"), "involved")
    spark = texts.sparkSession
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * max(1, involved.count()) - 1).bit_length()))
    folder = shared_folder(spark, "involved-filter")
    files = Files(folder)
    files.make()
    spots = [F.pmod(F.xxhash64(F.lit(i), F.coalesce(F.col("class_id").cast("long"), F.lit(-1))), F.lit(bits)) for i in (1, 2)]
    words = involved.select(F.explode(F.array(*spots)).alias("bit")).select(
        F.expr("bit div 64").alias("word"), (F.col("bit") % 64).cast("int").alias("place")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("value"))
    table = np.zeros(bits // 64, dtype=np.uint64)
    for word, value in words.toLocalIterator(prefetchPartitions=False):
        table[word] = np.uint64(value & (2**64 - 1))
    files.write("bits", table.tobytes())

    def some(batches):
        held = np.frombuffer(Files(folder).read("bits"), dtype=np.uint64)
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for i in (2, 3):
                bit = b.column(i).to_numpy()
                keep &= (held[bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["doc_id", "text"]).filter(pa.array(keep))

    def right_set(batches):
        hasher, seen = BlockHasher(fold=True), set()
        for b in batches:
            keep, found = [], []
            for want, s in zip(b.column(0).to_pylist(), shingles(hasher, b.column(1), n)):
                keep.append(want not in seen and set_id(s) == want)
                if keep[-1]:  # not before: texts of other sets come with an id that is taken or null
                    seen.add(want)
                    if not whole:
                        found.append(s.tobytes())
            some = b.filter(pa.array(keep, pa.bool_()))
            yield some if whole else pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary())], ["set", "shingles"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    marked = texts.withColumnRenamed("doc_id", "class_id")
    passed = marked.select("class_id", "text", *[c.alias(f"s{i}") for i, c in enumerate(spots)]).mapInArrow(
        some, f"doc_id {kind}, text string")
    same = passed["doc_id"].eqNullSafe(involved["class_id"])
    chosen = passed.join(involved, same).select("set", "text")
    kept = "set binary, text string" if whole else "set binary, shingles binary"
    return written(chosen.mapInArrow(right_set, kept).dropDuplicates(["set"]), "members")


def _joined(lists: DataFrame, members: DataFrame, n: int, threshold: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """(node, root) for the sets of lists that are linked."""
    p, q = threshold

    def near(a: str, b: str):
        return F.least(a, b) * q >= F.greatest(a, b) * p

    pairs = lists.where((F.col("set") != F.col("centre")) & near("n", "m")).select(
        F.least("set", "centre").alias("u"), F.greatest("set", "centre").alias("v")).distinct()
    links = written(_verified(written(pairs, "pairs"), members, n, threshold), "links")
    roots = written(components(links), "roots")

    # lists whose members are not in one component yet: every pair of two components is verified, by star centre
    labelled = lists.where("more").select("key", "set", "n", "centre").join(
        roots.select(F.col("node").alias("set"), "root"), "set", "left").select(
        "key", "set", "n", "centre", F.coalesce("root", "set").alias("c"))
    labelled = written(labelled, "long-lists")
    mixed_keys = labelled.groupBy("key").agg(F.min(F.xxhash64("c")).alias("low"), F.max(F.xxhash64("c")).alias("high")).where(
        "low != high").select("key")
    groups = labelled.join(mixed_keys, "key", "left_semi").select("centre", "set", "n", "c").distinct()
    more = written(_rest(groups, members, n, threshold, block), "more-links")
    if not more.isEmpty():
        roots = written(components(links.unionByName(more)), "roots")
    return roots


def jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                 threshold: tuple[int, int] = (75, 100), block: tuple[int, int] = (512, 200_000),
                 links: bool = False) -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, class_id (least id with the same set), component_id,
    root (one set of the component, which names it also where ids are null or repeated; null without shingles) and tag
    (xxhash64 of the text, which tells rows with one id apart).

    With `links` also n_links, the number of other rows at or above the threshold: every pair of different sets is
    compared, so a group of near copies takes its square of comparisons, though not of rows.

    `block` bounds the members and shingles of a block when the rest is verified; it moves work, not results.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(_sets(documents, id_col, text_col, n, links), "sets")
    bits = [F.first("bits").alias("bits")] if links else []
    classes = sets.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"),
        F.count(F.lit(1)).alias("copies"), *bits)
    sizes = classes.groupBy("n").count().where(F.col("n") <= 2 * LARGEST_LIGHT)
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    folder, mean_list = _rarity(texts, n, total)
    x = boundary({r["n"]: r["count"] for r in sizes.collect()}, mean_list, threshold)
    lists = written(_lists(_postings(texts, n, threshold, folder, x)), "lists")

    if links:
        groups = written(lists.select(F.xxhash64("centre").alias("g"), "set", "n").distinct(), "groups")
        placed = groups.groupBy("set").agg(F.collect_list("g").alias("all")).join(
            classes.select("set", "n", "copies", "bits"), "set")
        some = written(_possible(groups, placed, threshold, block), "possible")
        members = _members(texts, some, classes, n, whole=False)
        found = written(_counted(some, placed.drop("n", "bits"), members, threshold, block), "counted-links")
        roots = written(components(found.where("v is not null").select("u", "v")), "roots")
        linked = found.where("v is null").groupBy("u").agg(F.sum("linked").alias("linked"))
    else:
        roots, linked = _joined(lists, _members(texts, lists, classes, n), n, threshold, block), None

    named = classes.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select(
        "set", "class_id", F.coalesce("root", "set").alias("root"), "copies")
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    final = named.join(least, "root").select("set", "class_id", "component_id", "copies", "root")
    counts = []
    if linked is not None:
        final = final.join(linked.withColumnRenamed("u", "set"), "set", "left")
        counts = [F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).alias("n_links")]
    return sets.join(final, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *counts, "root", "tag")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN
         list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
             FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
          WHERE 100 * k >= 75 * (x.n + y.n - k)),
reached AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION
            SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v),
names AS (SELECT u AS doc_id, min(v) AS component_id FROM reached GROUP BY u),
same AS (SELECT doc_id, list_sort(list(s)) AS members FROM shingles GROUP BY doc_id),
classes AS (SELECT members, min(doc_id) AS class_id FROM same GROUP BY members)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(class_id, d.doc_id) AS class_id
FROM documents d JOIN names USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN same USING (doc_id)
LEFT JOIN classes USING (members)"""

# the same with the number of other documents at or above the threshold
LINKS_SQL = ORACLE_SQL.replace("\nSELECT d.doc_id, coalesce(n, 0) AS n_shingles", """, linked AS (SELECT u AS doc_id, count(*) AS n_links FROM links GROUP BY u)
SELECT d.doc_id, coalesce(n_links, 0) AS n_links, coalesce(n, 0) AS n_shingles""").replace(
    "LEFT JOIN sizes USING", "LEFT JOIN linked USING (doc_id) LEFT JOIN sizes USING")
