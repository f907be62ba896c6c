"""Conflict-constrained best-fit packing of documents into fixed-size sequences.

A document longer than a bin fills whole bins; what is left of it (or a shorter document) goes to the tightest bin that
has room and no conflict: no document of the same source and none of the same duplicate cluster. Longest first. Clusters
are the components of near copies (`with_clusters`) or, where duplicates are gone, equal texts (`with_lengths`).

Open bins stand in a tree ordered by residual room. A bin carries a bitmap of its sources and clusters, a tree node the
intersection of the bitmaps below it: where that holds a bit of the document, all bins below conflict and are passed at
once. The search goes to the first residual that fits and on to its successors until a compatible bin is found; if there
is none, a bin is opened.

Documents are dealt by a hash of their id into groups of about `group_bins` bins, and bins do not cross groups; a group
is one task of bounded size, and a source or cluster that holds a third of all rows is spread over all of them.

Defined cases: null or empty text has length 0 and gets one row without a bin (such rows are dealt to no group); a null source conflicts with nothing;
repeated rows are documents of one cluster; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffscope.llm.near_dedup import near_duplicates
from diffscope.llm.store import written

CAPACITY = 2048
GROUP_BINS = 4000
WORDS = r"[^\x20\x09-\x0D]+"
EMPTY = -1  # intersection of no bitmaps: all bits
FREE = 1  # a bit that no bin has, so only nodes without bins hold it


class Bins:
    """Open bins by residual room."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.leaves = 1 << capacity.bit_length()
        self.tree = [EMPTY] * (2 * self.leaves)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # residual -> bitmap -> bins, oldest first

    def _update(self, residual: int) -> None:
        both = EMPTY
        for mask in self.at[residual]:
            both &= mask
        i = residual + self.leaves
        while i and self.tree[i] != both:
            self.tree[i] = both
            i >>= 1
            both = self.tree[2 * i] & self.tree[2 * i + 1] if i else both

    def _successor(self, residual: int, need: int) -> int | None:
        """The first residual from `residual` on whose bins do not all conflict."""
        i = residual + self.leaves
        while self.tree[i] & need:
            while i & 1:  # last child: up to a node that has a right neighbour
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i *= 2
            if self.tree[i] & need:
                i += 1
                if self.tree[i] & need:  # neither child can do: go on to the right
                    return self._successor_after(i, need)
        return i - self.leaves

    def _successor_after(self, node: int, need: int) -> int | None:
        while node < self.leaves:
            node = 2 * node + 1
        residual = node - self.leaves + 1
        return self._successor(residual, need) if residual < self.leaves else None

    def put(self, size: int, need: int) -> tuple[int, int]:
        """(bin, position) for a piece whose source and cluster bits are `need`."""
        residual = self._successor(size, need | FREE) if self.count else None
        while residual is not None and residual <= self.capacity:
            fits = [(bins[0], mask) for mask, bins in self.at[residual].items() if not mask & need]
            if fits:
                number, mask = min(fits)
                bins = self.at[residual][mask]
                bins.pop(0)
                if not bins:
                    del self.at[residual][mask]
                self._update(residual)
                self._open(number, residual - size, mask | need)
                return number, self.capacity - residual
            residual = self._successor(residual + 1, need | FREE) if residual < self.capacity else None
        number = self.count
        self.count += 1
        self._open(number, self.capacity - size, need)
        return number, 0

    def _open(self, number: int, residual: int, mask: int) -> None:
        if residual:
            insort(self.at[residual].setdefault(mask, []), number)
            self._update(residual)


def pack_group(rows: list[tuple], capacity: int) -> list[tuple]:
    """(id, piece, start, length, bin, position) for rows (id, length, source, cluster) in packing order."""
    bins, out = Bins(capacity), []
    bits: dict[tuple, int] = {}
    members: dict = {}
    for _, _, _, cluster in rows:
        members[cluster] = members.get(cluster, 0) + 1
    for doc, length, source, cluster in rows:
        if not length:
            out.append((doc, 0, 0, 0, None, None))
            continue
        need = 0
        if source is not None:
            need |= 1 << bits.setdefault(("source", source), len(bits) + 1)
        if members[cluster] > 1:
            need |= 1 << bits.setdefault(("cluster", cluster), len(bits) + 1)
        whole, rest = divmod(length, capacity)
        for piece in range(whole):
            out.append((doc, piece, piece * capacity, capacity, bins.count, 0))
            bins.count += 1
        if rest:
            number, position = bins.put(rest, need)
            out.append((doc, whole, whole * capacity, rest, number, position))
    return out


def with_lengths(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `length` (white-space separated words) and `cluster` (hash of the lower-cased text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.withColumn("length", F.regexp_count(text, F.lit(WORDS)).cast("long")).withColumn(
        "cluster", F.xxhash64(F.lower(text)))


def with_clusters(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """`with_lengths`, the cluster being the group of near copies (five words, 0.75) of the lower-cased text.

    `find` gives doc_id, tag and root: `near_duplicates` misses a link with odds of 8e-8, `ngram_join.jaccard_join` none,
    at three times the work.
    """
    lengths = with_lengths(documents, text_col).drop(text_col)
    lower = documents.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    found = find(lower).where(F.col("root").isNotNull()).select("doc_id", "tag", "root").dropDuplicates(["doc_id", "tag"])
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("f.doc_id")) & (F.col("d.cluster") == F.col("f.tag"))
    kept = [F.col(f"d.{c}") for c in lengths.columns if c != "cluster"]
    return lengths.alias("d").join(found.alias("f"), same, "left").select(
        *kept, F.coalesce(F.xxhash64("f.root"), F.col("d.cluster")).alias("cluster"))


def pack(documents: DataFrame, id_col: str = "doc_id", length_col: str = "length", source_col: str = "source",
         cluster_col: str = "cluster", capacity: int = CAPACITY, group_bins: int = GROUP_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, position (bin_id and position null for empty documents)."""
    rows = written(documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(length_col).cast("long").alias("length"),
        F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("long").alias("cluster")), "lengths")
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // (capacity * group_bins)))
    empty = rows.where(F.coalesce("length", F.lit(0)) == 0).select(
        "doc_id", F.lit(0).alias("piece"), *[F.lit(0).cast("long").alias(c) for c in ("start", "length")],
        *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "position")])
    dealt = rows.where("length > 0").withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)).cast("int")).repartitionById(
        int(groups), F.col("group")).sortWithinPartitions(
        "group", F.desc(F.col("length") % capacity), "doc_id", "cluster", "source").select(
        "group", "doc_id", "length", "source", "cluster")

    def run(batches):
        group, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != group and held:
                    yield result(group, held)
                    held = []
                group = row[0]
                held.append(row[1:])
        if held:
            yield result(group, held)

    def result(group, held):
        doc, piece, start, length, number, position = zip(*pack_group(held, capacity))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array([None if n is None else (group << 32) + n for n in number], pa.int64()),
             pa.array(position, pa.int64())], ["doc_id", "piece", "start", "length", "bin_id", "position"])

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, bin_id long, position long").unionByName(empty)
