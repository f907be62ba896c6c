"""Deterministic range shards: the same rows always get the same shard, whatever the partitions they come in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = 2**63 - 1  # place of a null key
PER_SHARD = 100  # sampled keys per shard: cuts are off by about a tenth of a shard
MOST = 1 << 20  # sampled keys at most (16 MB): with more than 10,000 shards there are fewer per shard


def place(key: str) -> Column:
    """Order of a nullable integer key, nulls last."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST))


def cuts(sizes: DataFrame, target: int) -> np.ndarray:
    """First keys of the second and later shards of about `target` bytes, from rows (place, bytes).

    They come from the keys of at least a shard's size, and from a sample of the others whose hash is small, so they
    depend on the keys alone. A key counts once with all its bytes, so one that very many rows share is one row here. Cuts
    only balance the shards. Sizes of 0 make no shards; an empty table has no cuts.
    """
    rows, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = -(-int(total) // target)
    if shards <= 1:
        return np.zeros(0, dtype=np.int64)
    share = min(1.0, min(PER_SHARD * shards, MOST) / rows)
    cells = 1 << 62
    large = F.col("bytes") >= target  # at most `shards` keys
    some = sizes.groupBy("place").agg(F.sum("bytes").alias("bytes")).where(
        large | (F.xxhash64("place").bitwiseAND(F.lit(cells - 1)) <= int(share * (cells - 1))))
    found = np.array([tuple(r) for r in some.select("place", "bytes").collect()], dtype=np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0], kind="stable")]
    weight = np.cumsum(np.where(found[:, 1] >= target, found[:, 1], found[:, 1] / share))
    reached = np.floor(weight * shards / max(1.0, float(weight[-1]) if len(weight) else 1.0))
    return np.unique(found[np.flatnonzero(np.diff(reached, prepend=0) > 0), 0])


def shard_of(where: np.ndarray, key: Column) -> Column:
    """Number of the shard of a place."""

    def number(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(where, keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return F.arrow_udf(number, "int")(key) if len(where) else F.lit(0)


def dealt(df: DataFrame, where: np.ndarray, *order: str) -> DataFrame:
    """Rows of one shard (column `shard`) in one partition, sorted by shard and `order`."""
    return df.repartitionById(len(where) + 1, F.col("shard")).sortWithinPartitions("shard", *order)
