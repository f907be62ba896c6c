"""Running totals and row numbers in an order, without a window over a whole group.

A window partition is one task, so a group that holds a third of all rows must not be one. The order value becomes a 64-bit
key whose integers are ordered like the values, and rows are counted by the key's leading 16 bits. Prefixes of at most
`bound` rows are windowed on their own; those with more are counted by the next 16 bits, and so on, and rows that tie in
the whole key by the bits of a digest. The totals of earlier prefixes are prefix sums over at most 65,536 counts of one
parent, so no window holds more than `bound` rows (unless more rows than that are equal in key and ties, where any order
will do) or 65,536 counts. Results are exact, whatever the distribution.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffscope.operators.distances import matched
from diffscope.session import written

BUCKET = "_bucket"
BOUND = 1_000_000


def hash_buckets(df: DataFrame, digest: str, digits: int = 3) -> DataFrame:
    """Add an ordered bucket from the leading hex digits of a digest column; uniform whatever the keys."""
    return df.withColumn(BUCKET, F.conv(F.substring(digest, 1, digits), 16, 10).cast("int"))


def _ordered_bits(values: pa.Array) -> pa.Array:
    x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
    bits = x.view(np.int64)
    bits = np.where(np.isnan(x), np.int64(2**63 - 1), np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))
    return pa.array(bits, mask=values.is_null().to_numpy(zero_copy_only=False))


def order_key(df: DataFrame, column: str) -> Column:
    """A LONG ordered like the column (numbers, dates and times; NaN last); null is the least."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        key = F.arrow_udf(_ordered_bits, "long")(value.cast("double"))
    elif isinstance(kind, T.TimestampType):
        key = F.unix_micros(value)
    elif isinstance(kind, T.DateType):
        key = F.unix_date(value).cast("long")
    elif isinstance(kind, T.IntegralType):
        key = value.cast("long")
    else:
        raise TypeError(f"no order key for {kind.simpleString()}")
    return F.coalesce(key, F.lit(-2**63))


def digest_key(digest: str) -> Column:
    """A LONG ordered like a column of hex digests, by their first 15 digits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def running_total(df: DataFrame, by: list[str], key: Column, ties: list[str], value: Column, output: str,
                  bound: int = BOUND) -> DataFrame:
    """Add the sum of `value` over the rows before and including each row, within the group `by` (null is a group).

    Rows are ordered by `key` (see `order_key`), those with one key by a digest of the columns `ties`, then by these.
    """
    names = df.columns
    tie = F.xxhash64(*ties) if ties else F.lit(0).cast("long")
    rest = df.select("*", key.alias("_key"), tie.alias("_tie"), value.alias("_value"), F.lit(0).alias("_before"))
    digits = [F.shiftright("_key", 48)] + [F.shiftrightunsigned("_key", s).bitwiseAND(F.lit(0xFFFF)) for s in (32, 16, 0)]
    digits += [F.shiftright("_tie", 48)] + [F.shiftrightunsigned("_tie", s).bitwiseAND(F.lit(0xFFFF)) for s in (32, 16, 0)]
    done: list[DataFrame] = []
    for level, digit in enumerate(digits):
        rest = rest.withColumn(f"_d{level}", digit.cast("int"))
        path = [f"_d{i}" for i in range(level + 1)]
        earlier = Window.partitionBy(*by, *path[:-1]).orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, -1)
        counts = written(rest.groupBy(*by, *path).agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_total")).select(
            *by, *path, "_n", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_step")))
        full = counts.where(F.col("_n") > bound).select(*by, *path)
        last = level == len(digits) - 1 or full.isEmpty()
        placed = matched(rest, counts, [*by, *path]).withColumn("_before", F.col("_before") + F.col("_step")).drop("_step")
        small = placed if last else placed.where(F.col("_n") <= bound)
        inside = Window.partitionBy(*by, *path).orderBy("_key", "_tie", *ties).rowsBetween(Window.unboundedPreceding, 0)
        done.append(small.withColumn(output, F.col("_before") + F.sum("_value").over(inside)).select(*names, output))
        if last:
            break
        rest = placed.where(F.col("_n") > bound).drop("_n")
    return reduce(DataFrame.unionByName, done)


def row_numbers(df: DataFrame, digest: str, output: str = "row_idx", by: list[str] | None = None,
                bound: int = BOUND) -> DataFrame:
    """Number rows 1..n (per group) in the order of the first 15 hex digits of a digest column."""
    return running_total(df, by or [], digest_key(digest), [digest], F.lit(1), output, bound)
