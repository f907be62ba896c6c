"""Embedding whitening by polarisation covariance.

Entries become integers x = floor(scale * c) + shift, so all sums are exact. With y = x - round(mean), tasks add up the
squares of y for every dimension and of y_i + y_j for every pair of dimensions, as integers. Half the difference of the
variance of a pair sum and the variances of its two parts is their covariance; it is formed from exact integers and rounded
once. The matrix (as many rows as dimensions) goes through eigh on the driver, and the vectors through numpy inside tasks.

What reaches the driver are sums per dimension and pair, whatever the number of rows; tasks combine their batches first.

Defined cases: a vector that is null or holds null, non-finite or unrepresentable entries (beyond 2^52 / scale) is dropped,
also an empty one; of several lengths the most frequent counts (of equally frequent ones the longest), others are dropped;
null, repeated ids are kept; components without variance (eigenvalue at most 1e-12 of the largest) have null `whitened`
and take no part in `identity_error`; `explained` is null where the trace is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
NO_VARIANCE = 1e-12
SAFE = 1 << 62
EXACT = "decimal(38,0)"
CELLS = 1 << 20  # entries of one block of pair sums


def integers(vectors: pa.Array, width: int | None, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the usable vectors of `width` entries and their integer entries; without `width`, of all, and their lengths."""
    kind = np.int64 if pa.types.is_large_list(vectors.type) else np.int32
    offsets = np.frombuffer(vectors.buffers()[1], dtype=kind)[vectors.offset:vectors.offset + len(vectors) + 1].astype(np.int64) \
        if len(vectors) else np.zeros(1, dtype=np.int64)
    values = vectors.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    good = np.abs(values) <= (1 << 52) / scale  # false for nan
    bad = np.concatenate(([0], np.cumsum(~good)))
    use = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    if width is not None:
        use &= size == width
    rows = np.flatnonzero(use)
    if width is None:
        return rows, size[rows]
    x = values[offsets[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    return rows, np.floor(scale * x).astype(np.int64) + shift


def _added(df: DataFrame, keys: tuple[str, ...], *sums: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def _decimals(values) -> pa.Array:
    """Python integers of up to 38 digits."""
    with localcontext() as exact:
        exact.prec = 60
        return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def first_moments(vectors: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of usable vectors of the most frequent length, and the sums of their entries."""

    def run(batches):
        sums: dict[int, list] = {}
        for b in batches:
            rows, sizes = integers(b.column(0), None, scale, shift)
            for width in set(sizes.tolist()):
                _, x = integers(b.column(0), width, scale, shift)
                held = sums.setdefault(width, [0, np.zeros(width, dtype=object)])
                held[0] += len(x)
                held[1] += _exact_sum(x)
        for width, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * width, pa.int32()), pa.array(np.arange(width), pa.int32()),
                 pa.array([n] * width, pa.int64()), _decimals(total)], ["width", "i", "n", "total"])

    sums = _added(vectors.mapInArrow(run, f"width int, i int, n long, total {EXACT}"), ("width", "i"), "n", "total")
    best = sums.groupBy("width").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "total"))).alias(
        "totals")).orderBy(F.desc("n"), F.desc("width")).first()
    return (best["n"], [int(r["total"]) for r in best["totals"]]) if best else (0, [])


def _exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers, without overflow."""
    most = int(np.abs(x).max(initial=0)) + 1
    step = max(1, SAFE // most)
    total = np.zeros(x.shape[1], dtype=object)
    for low in range(0, len(x), step):
        total += x[low:low + step].sum(axis=0).astype(object)
    return total


def _squares(y: np.ndarray) -> np.ndarray:
    """Sums of the squared columns as Python integers: by parts of 30 bits where 64 bits would not hold them."""
    most = int(np.abs(y).max(initial=0))
    if (most * most + 1) * max(1, len(y)) < SAFE:
        return np.einsum("ij,ij->j", y, y).astype(object)
    high, low = y >> 30, y & ((1 << 30) - 1)
    return (_exact_sum(high * high) << 60) + (_exact_sum(high * low) << 31) + _exact_sum(low * low)


def pair_squares(vectors: DataFrame, width: int, centre: np.ndarray, scale: int, shift: int) -> dict[tuple[int, int], int]:
    """Exact sums of (y_i + y_j)^2 for i < j and of y_i^2 (key (i, i)), y being x - centre."""
    left, right = np.triu_indices(width)

    def run(batches):
        total = np.zeros(len(left), dtype=object)
        rows_in = 0
        for b in batches:
            _, x = integers(b.column(0), width, scale, shift)
            y = x - centre
            rows_in += len(y)
            step = max(1, CELLS // max(1, width))
            for low in range(0, len(y), step):
                part = np.asfortranarray(y[low:low + step])
                at = 0
                for i in range(width):
                    sums = part[:, i:i + 1] + part[:, i:]
                    sums[:, 0] = part[:, i]
                    total[at:at + width - i] += _squares(sums)
                    at += width - i
        if rows_in:
            for low in range(0, len(left), 50_000):
                cut = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left[cut], pa.int32()), pa.array(right[cut], pa.int32()), _decimals(total[cut])], ["i", "j", "total"])

    found = _added(vectors.mapInArrow(run, f"i int, j int, total {EXACT}"), ("i", "j"), "total").collect()
    return {(r["i"], r["j"]): int(r["total"]) for r in found}


@dataclass
class Whitening:
    """A fitted transformation: rows of `directions` are unit eigenvectors by falling eigenvalue."""

    n: int
    totals: list[int]
    eigenvalues: np.ndarray
    directions: np.ndarray
    trace: float
    scale: int
    shift: int

    @property
    def width(self) -> int:
        return len(self.totals)

    @property
    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.totals])

    @property
    def usable(self) -> np.ndarray:
        return self.eigenvalues > NO_VARIANCE * max(self.eigenvalues.max(initial=0.0), 0.0)


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Mean, eigenvalues and eigenvectors over all usable vectors; None without any."""
    only = vectors.select(F.col(vector_col).cast("array<double>").alias("vector"))
    n, totals = first_moments(only, scale, shift)
    if not n:
        return None
    width = len(totals)
    centre = [(2 * t + n) // (2 * n) for t in totals]  # rounded mean
    offset = [t - n * c for t, c in zip(totals, centre)]  # sums of y
    squares = pair_squares(only, width, np.array(centre, dtype=np.int64), scale, shift)

    def variance(i: int, j: int) -> int:
        """n^2 times the variance of y_i + y_j (of y_i for i = j)."""
        s = offset[i] if i == j else offset[i] + offset[j]
        return n * squares[i, j] - s * s

    own = [variance(i, i) for i in range(width)]
    cov = np.empty((width, width))
    for i in range(width):
        cov[i, i] = own[i] / (n * n)
        for j in range(i + 1, width):
            cov[i, j] = cov[j, i] = (variance(i, j) - own[i] - own[j]) / (2 * n * n)
    values, columns = np.linalg.eigh(cov)
    directions = columns.T[::-1].copy()
    sign = np.sign(directions[np.arange(width), np.abs(directions).argmax(axis=1)])
    return Whitening(n, totals, values[::-1].copy(), directions * sign[:, None], sum(own) / (n * n), scale, shift)


def _projected(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    """Whitened values of the first k components; nan where there is no variance."""
    # x - S / n in two exact steps: an integer centre, then the rest of the mean
    centre = [(2 * t + model.n) // (2 * model.n) for t in model.totals]
    rest = np.array([(t - model.n * c) / model.n for t, c in zip(model.totals, centre)])
    y = (x - np.array(centre, dtype=np.int64)).astype(np.float64) - rest
    with np.errstate(divide="ignore", invalid="ignore"):
        root = np.where(model.usable[:k], np.sqrt(np.maximum(model.eigenvalues[:k], 0)), np.nan)
    return (y @ model.directions[:k].T) / root


def _deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Sum over dimensions of (n x - S)^2 of each row, exact."""
    centre = np.array([(2 * t + model.n) // (2 * model.n) for t in model.totals], dtype=np.int64)
    offset = [t - model.n * int(c) for t, c in zip(model.totals, centre)]
    y = x - centre
    most = (int(np.abs(y).max(initial=0)) + 1) * model.n
    if most * most * model.width < SAFE:
        d = y * model.n - np.array(offset, dtype=np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    # sum of n^2 y^2 - 2 n y t + t^2 over dimensions, t = offset
    t = np.array(offset, dtype=object)
    squares, cross = _squares(np.asfortranarray(y.T)), (y.astype(object) * t).sum(axis=1)
    return [model.n ** 2 * int(s) - 2 * model.n * int(c) + sum(int(v) ** 2 for v in offset) for s, c in zip(squares, cross)]


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", components: int = COMPONENTS) -> float:
    """Largest absolute entry of the covariance of the whitened values minus the identity."""
    k = min(components, model.width)

    def run(batches):
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            _, x = integers(b.column(0), model.width, model.scale, model.shift)
            if not len(x):
                continue
            w = np.nan_to_num(_projected(x, model, k))
            own = w.mean(axis=0)
            w = w - own
            step, both = own - mean, n + len(w)
            spread += w.T @ w + np.outer(step, step) * (n * len(w) / both)
            mean += step * (len(w) / both)
            n = both
        if n:
            i, j = np.indices((k, k)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array((n * mean)[i]), pa.array(
                    (spread + n * np.outer(mean, mean)).reshape(-1))], ["i", "j", "total", "products"])

    only = vectors.select(F.col(vector_col).cast("array<double>").alias("vector"))
    found = _added(only.mapInArrow(run, "i int, j int, total double, products double"), ("i", "j"), "total", "products").collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in found:
        mean[r["i"]] = r["total"] / model.n
        cov[r["i"], r["j"]] = r["products"] / model.n
    use = model.usable[:k]
    error = np.abs(cov - np.outer(mean, mean) - np.eye(k))[np.ix_(use, use)]
    return float(error.max(initial=0.0))


def whitened(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector: vec_id, deviation (exact) and whitened (array of the first components)."""
    k = min(components, model.width)

    def run(batches):
        for b in batches:
            rows, x = integers(b.column(1), model.width, model.scale, model.shift)
            w = _projected(x, model, k)
            flat = pa.array(w.reshape(-1), pa.float64(), from_pandas=True)  # nan becomes null
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), _decimals(_deviations(x, model)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), flat)],
                ["vec_id", "deviation", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(
        run, f"vec_id {kind}, deviation {EXACT}, whitened array<double>")


def table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    `deviation` is null where it does not fit in 64 bits; `whitened` (the function) has it exact.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    model = fit(vectors, vector_col)
    if model is None:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = min(components, model.width)
    error = identity_error(vectors, model, vector_col, components)
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace else None).cast("double") for e in model.eigenvalues[:k]])
    rows = whitened(vectors, model, id_col, vector_col, components)
    return rows.select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias(
        "at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"))
