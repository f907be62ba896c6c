"""Deterministic splits and samples: everything is decided by a digest of the row's key, so a lost task that is run again
makes the same choice."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffscope.operators.distances import matched
from diffscope.operators.ordered import hash_buckets
from diffscope.session import written

BUCKET = "_bucket"


def key_digest(key: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def _cut_points(df: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by, _cut): the digest of the ceil(share * n)-th row of each group, in digest order.

    Counts per digest prefix find the one prefix in which the cut falls; only that prefix's rows are ranked.
    """
    counts = df.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy(BUCKET)
    ranked = counts.select(
        *by, BUCKET, "_n",
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.ceil(F.lit(share) * F.sum("_n").over(Window.partitionBy(*by))).alias("_want"))
    hit = (ranked.where((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_n")))
           .select(*by, BUCKET, (F.col("_want") - F.col("_before")).alias("_rank")))
    inside = matched(df, hit, [*by, BUCKET])
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_digest"))
    return inside.withColumn("_place", place).where("_place = _rank").select(*by, F.col("_digest").alias("_cut"))


def stratified_split(df: DataFrame, key: list[str], label: str | None = "label", test: float = 0.2,
                     validation: float = 0.0, seed: int = 42, digits: int = 4) -> DataFrame:
    """Add `split`: exactly ceil(share * n) rows of each class become test (and validation), the rest train.

    Rows without a label are a class of their own.
    No class is ever sorted as a whole: see `_cut_points`. `digits` hex digits give 16**digits prefixes.
    """
    by = [label] if label else []
    marked = hash_buckets(df.withColumn("_digest", key_digest(key, seed)), "_digest", digits)
    narrow = marked.select(*by, BUCKET, "_digest")
    shares = [("test", test)] + ([("validation", test + validation)] if validation else [])
    out = marked
    split = None
    for name, share in shares:
        cut = _cut_points(narrow, by, share).withColumnRenamed("_cut", f"_cut_{name}")
        # one row per class
        out = matched(out, cut, by, "left") if by else out.withColumn(f"_cut_{name}", cut.scalar())
        chosen = F.col("_digest") <= F.col(f"_cut_{name}")
        split = F.when(chosen, name) if split is None else split.when(chosen, name)
    return out.withColumn("split", split.otherwise("train")).drop(
        BUCKET, "_digest", *[f"_cut_{name}" for name, _ in shares])


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the smallest digests (a top-n, each task keeps at most n rows)."""
    return df.orderBy(key_digest(key, seed)).limit(n)


def _uniform(*parts: Column) -> Column:
    """Uniform number in (0, 1) from a hash of `parts`."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


DIGITS = 3  # hex digits of a digest that one level of drawing looks at
LEAF_ROWS = 4096


def _allotted(sizes: pa.Array, draws: pa.Array, seeds: pa.Array) -> pa.Array:
    """Draws of each child of some parents: multinomial by the children's sizes, decided by the parent's seed."""
    out = [np.random.default_rng(s % 2**64).multinomial(m, np.array(n) / sum(n)).tolist()
           for n, m, s in zip(sizes.to_pylist(), draws.to_pylist(), seeds.to_pylist())]
    return pa.array(out, pa.list_(pa.int64()))


def drawn_with_replacement(df: DataFrame, digest: str, total: int, copies: int, seed: int = 42) -> DataFrame:
    """`copies` rows of the `total` rows of `df`, drawn with replacement, with a distinct number `_copy` from 0 on.

    Rows are grouped by the leading digits of a digest, at most a few thousand to a group. Draws are dealt from the whole to
    the groups by multinomials over the groups' sizes, three digits at a time, and within a group to its rows by local
    rank. Each draw is uniform over all rows, and nothing is numbered over the whole table.
    """
    levels = 0
    while total > LEAF_ROWS * 16 ** (DIGITS * levels):
        levels += 1
    leaf = F.substring(digest, 1, DIGITS * levels) if levels else F.lit("")
    rows = df.withColumn("_leaf", leaf)
    sizes = written(rows.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n")))
    dealt = df.sparkSession.createDataFrame([("", copies)], "_leaf string, _draws long")
    for level in range(levels):
        def prefix(n):
            return F.substring("_leaf", 1, DIGITS * n) if n else F.lit("")

        children = sizes.groupBy(prefix(level + 1).alias("_leaf")).agg(F.sum("_n").alias("_n")).withColumn(
            "_up", prefix(level))
        lists = children.groupBy("_up").agg(F.sort_array(F.collect_list(F.struct("_leaf", "_n"))).alias("_all"))  # at most 4096
        both = lists.join(dealt.withColumnRenamed("_leaf", "_up"), "_up")
        share = F.arrow_udf(_allotted, "array<long>")(
            F.col("_all")["_n"], F.col("_draws"), F.xxhash64("_up", F.lit(seed)))
        dealt = written(both.select(F.explode(F.arrays_zip(F.col("_all")["_leaf"].alias("leaf"), share.alias("draws"))).alias(
            "_x")).select(F.col("_x.leaf").alias("_leaf"), F.col("_x.draws").alias("_draws")))
    width = 1 if levels == 0 else 16 ** (DIGITS * levels)
    place = F.coalesce(F.conv("_leaf", 16, 10).cast("long"), F.lit(0)) if levels else F.lit(0).cast("long")
    draws = sizes.join(dealt.where("_draws > 0"), "_leaf").select("_leaf", "_n", place.alias("_place"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("_draws") - 1)).alias("_i")).select(
        "_leaf", (F.col("_i") * width + F.col("_place")).alias("_copy"), "_n")
    draws = draws.withColumn("_rank", (F.floor(_uniform(F.col("_copy"), F.lit(seed)) * F.col("_n")) + 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy("_leaf").orderBy(digest))
    return rows.withColumn("_rank", rank).join(draws.drop("_n"), ["_leaf", "_rank"]).drop("_leaf", "_rank")


def _new_key(df: DataFrame, key: list[str]) -> dict[str, Column]:
    """Key columns of copies that no row has: the first text or integer column of the key gets a new value."""
    for name in key:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            return {name: F.concat_ws("-", name, F.lit("copy"), F.col("_copy").cast("string"))}
        if isinstance(kind, T.IntegralType):
            top = df.agg(F.coalesce(F.max(name), F.lit(0)).cast("long")).scalar()
            return {name: (top + 1 + F.col("_copy")).cast(kind)}
    raise ValueError("the key needs a text or an integer column, which tells copies apart")


def oversample_single_class(df: DataFrame, key: list[str], features: str = "features", label: str = "label",
                            seed: int = 42, spread: float = 0.1) -> DataFrame:
    """If the data has one class only, add max(10, n // 4) jittered copies of random rows under the other class.

    The rows drawn (with replacement) and the Gaussian noise, `spread` times each feature's population deviation, come
    from hashes. Copies get keys of their own. `features` is an ARRAY<DOUBLE>. With two classes the input is returned
    unchanged.
    """
    classes = [r[0] for r in df.select(label).distinct().limit(2).collect()]
    if len(classes) != 1:
        return df
    total = df.count()
    deviations = (df.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("sd"))
                  .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sd"))), lambda s: s["sd"])))  # one number per feature
    marked = df.withColumn("_digest", key_digest(key, seed))
    picked = drawn_with_replacement(marked, "_digest", total, max(10, total // 4), seed).withColumn("_sd", deviations.scalar())

    def noise(i: Column) -> Column:
        u, v = _uniform(F.col("_copy"), i, F.lit(seed + 1)), _uniform(F.col("_copy"), i, F.lit(seed + 2))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)

    shaken = F.transform(features, lambda x, i: x + noise(i) * spread * F.element_at("_sd", i + 1))
    other = (1 - F.col(label)).cast(df.schema[label].dataType)
    extra = picked.withColumns({features: shaken, label: other, **_new_key(df, key)})
    return df.unionByName(extra.select(*df.columns))
