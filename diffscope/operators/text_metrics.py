"""BLEU and ROUGE for pairs of texts, inside the pair's row.

Tokens of a batch of pairs become numbers, n-grams numbers of (n-1)-gram and token, so equal numbers are equal n-grams. The
n-grams of each side are sorted with their pair into runs, and the two sorted lists of runs merged: the shared count of an
n-gram is the lesser of its two run lengths. Nothing is shuffled; the longest common subsequence is computed only where
ROUGE-L is asked for.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.functions.stem import stem_tokens
from diffscope.functions.text import WORD

# An n-gram precision of zero counts as the smallest normal double (no smoothing).
TINY = sys.float_info.min


def bleu_tokens(text: Column) -> Column:
    """Lower-cased words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)({WORD}+|[^\s\p{{L}}\p{{N}}_\x1c-\x1f])"), F.lit(1))


def rouge_tokens(text: Column, stem: bool = True) -> Column:
    """Lower-cased runs of ASCII letters and digits; longer words stemmed."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return stem_tokens(tokens) if stem else tokens


def _lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by bit-parallel rows: one big integer operation per token of `b`."""
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _lcs_batch(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([_lcs_length(a or [], b or []) for a, b in zip(left.to_pylist(), right.to_pylist())],
                    type=pa.int32())


def lcs_length(left: Column, right: Column) -> Column:
    return F.arrow_udf(_lcs_batch, "int")(left, right)


def _tokens(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a batch of token lists, and the number of the list of each."""
    lists = lists.fill_null([]) if lists.null_count else lists
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _runs(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs of equal (row, code): row, code, length."""
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])))) if len(codes) else order
    return rows[first], codes[first], np.diff(np.append(first, len(codes)))


def _overlaps(generated: pa.Array, reference: pa.Array, most: int) -> list[np.ndarray]:
    """For n = 1 to `most` the shared n-grams of each pair, each counted as often as it occurs on both sides."""
    (a, rows_a), (b, rows_b) = _tokens(generated), _tokens(reference)
    coded = pa.concat_arrays([a.cast(pa.string()), b.cast(pa.string())]).dictionary_encode().indices.to_numpy(
        zero_copy_only=False).astype(np.int64)
    rows = np.concatenate((rows_a, rows_b + len(generated)))  # the two sides of a pair are rows apart
    grams, out = coded, []
    for n in range(1, most + 1):
        if n > 1:  # an n-gram goes on where the next token is in the same row
            keep = rows[n - 1:] == rows[:len(rows) - n + 1] if len(rows) >= n else np.zeros(0, dtype=bool)
            pairs = grams[:len(keep)] * (int(coded.max(initial=0)) + 1) + coded[n - 1:n - 1 + len(keep)]
            _, grams = np.unique(pairs, return_inverse=True)
            codes, at = grams[keep], rows[:len(keep)][keep]
        else:
            codes, at = grams, rows
        row, code, length = _runs(codes, at)
        right = row >= len(generated)
        base = int(codes.max(initial=0)) + 1
        keys = [row[~right] * base + code[~right], (row[right] - len(generated)) * base + code[right]]
        _, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        shared = np.minimum(length[~right][i], length[right][j])
        out.append(np.bincount(keys[0][i] // base, weights=shared, minlength=len(generated)).astype(np.int64))
    return out


def shared_grams(generated: Column, reference: Column, most: int) -> Column:
    """ARRAY<LONG>: shared n-grams of two token arrays for n = 1 to `most`."""
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        found = np.stack(_overlaps(a, b, most), axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * most, pa.int32()), pa.array(found.reshape(-1)))

    return F.arrow_udf(count, "array<long>")(generated, reference)


def pair_scores(df: DataFrame, key: list[str], generated: str = "generated", reference: str = "reference",
                stem: bool = True, scores: tuple[str, ...] = ("bleu", "rouge1", "rouge2", "rougeL")) -> DataFrame:
    """(key, the wanted scores) per pair. Null texts are empty."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in (generated, reference)}
    wanted = {"b": "bleu" in scores, "r": any(s.startswith("rouge") for s in scores)}
    tokens = df.select(*key, *[
        make(text[side]).alias(f"{kind}{end}") for kind, make in (("b", bleu_tokens), ("r", lambda t: rouge_tokens(t, stem)))
        if wanted[kind] for side, end in ((generated, "g"), (reference, "r"))])
    found = {"b": shared_grams(F.col("bg"), F.col("br"), 4) if wanted["b"] else None,
             "r": shared_grams(F.col("rg"), F.col("rr"), 2) if wanted["r"] else None}
    longest = [lcs_length(F.col("rg"), F.col("rr")).alias("lcs")] if "rougeL" in scores else []
    sums = tokens.select(*key, *[c.alias(f"{k}_hit") for k, c in found.items() if c is not None], *longest, *[
        F.size(f"{k}{end}").alias(f"{k}{end}") for k in ("b", "r") if wanted[k] for end in ("g", "r")])

    def hit(kind: str, n: int) -> Column:
        return F.element_at(f"{kind}_hit", n)

    def log_precision(n: int) -> Column:
        of = F.greatest(F.lit(1), F.col("bg") - (n - 1))
        return F.log(F.when(hit("b", n) > 0, hit("b", n) / of).otherwise(F.lit(TINY)))

    def f_measure(shared: Column, gen: Column, ref: Column) -> Column:
        # 2PR/(P+R) with P = shared/gen and R = shared/ref
        precision, recall = F.try_divide(shared, gen), F.try_divide(shared, ref)
        return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    def score(name: str) -> Column:
        if name == "bleu":
            brevity = F.when(F.col("bg") > F.col("br"), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide("br", "bg")))
            mean = sum((F.lit(0.25) * log_precision(n) for n in (1, 2, 3, 4)), F.lit(0.0))
            return F.when(hit("b", 1) > 0, brevity * F.exp(mean)).otherwise(F.lit(0.0))
        if name == "rougeL":
            return f_measure(F.col("lcs"), F.col("rg"), F.col("rr"))
        n = {"rouge1": 1, "rouge2": 2}[name]
        return f_measure(hit("r", n), *[F.greatest(F.lit(0), F.col(c) - (n - 1)) for c in ("rg", "rr")])

    return sums.select(*key, *[score(name).alias(name) for name in scores])


def generation_metrics(df: DataFrame, key: list[str], generated: str = "generated", reference: str = "reference",
                       by: list[str] | None = None, stem: bool = True,
                       scores: tuple[str, ...] = ("bleu", "rouge1", "rouge2", "rougeL")) -> DataFrame:
    """Scores averaged over the pairs (per group)."""
    found = pair_scores(df, [*(by or []), *key], generated, reference, stem, scores)
    return found.groupBy(*(by or [])).agg(*[F.avg(c).alias(c) for c in scores])


def paired_by_position(generated: DataFrame, reference: DataFrame, index: str = "row_idx") -> DataFrame:
    """Join two text tables on a row index; surplus rows of the longer table drop out."""
    return generated.join(reference, index)
