"""Patches between two versions of a file, and texts from a version and a patch.

Lines become numbers, so that equal lines are equal numbers. Common ends are cut off, and lines that only one version has
can only be removed or added; what is left is aligned by a longest common subsequence, whose rows are the bits of one
integer each. Versions whose table of rows would be large are halved first, at the point where forward and backward rows
add up to most, so memory stays linear. The result is always a shortest edit script.

Both functions work on the row's two texts inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_BITS = 1 << 26  # rows of one alignment: 8 MB; larger ones are halved
CONTEXT = 3
NO_END = "\\ No newline at end of file"
HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def split_lines(text: str) -> list[str]:
    """Lines with their line feeds; only the last one may lack it."""
    lines = text.split("\n")
    return [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def _rows(a: list[int], b: list[int]):
    """After each element of `a`, the row of its table: bit j is 0 where the subsequence grows at b[j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        same = row & where.get(x, 0)
        row = ((row + same) | (row - same)) & full
        yield row


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of `a` with each b[:j]."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits[:len(b)].astype(np.int64))))


def matches(a: list[int], b: list[int], table_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Pairs (i, j) of a longest common subsequence of `a` and `b`, in order."""
    only = set(a) & set(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in only], [j for j, x in enumerate(b) if x in only]
    a, b = [a[i] for i in at_a], [b[j] for j in at_b]
    found: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 > 1 and (a1 - a0) * (b1 - b0) > table_bits:
            middle = (a0 + a1) // 2
            cut = b0 + int(np.argmax(_growth(a[a0:middle], b[b0:b1]) + _growth(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]))
            parts += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
            continue
        table = list(_rows(a[a0:a1], b[b0:b1]))
        i, j = a1 - a0, b1 - b0
        while i and j:
            if table[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or table[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append((a0 + i, b0 + j))
    return sorted((at_a[i], at_b[j]) for i, j in found)


def hunks(old: list[str], new: list[str], context: int = CONTEXT) -> list[list[str]]:
    """Unified hunks, each a list of lines that starts with its header."""
    numbers: dict[str, int] = {}
    pairs = matches([numbers.setdefault(x, len(numbers)) for x in old], [numbers.setdefault(x, len(numbers)) for x in new])
    changes, i, j = [], 0, 0  # (i0, i1, j0, j1): old[i0:i1] became new[j0:j1]
    for x, y in [*pairs, (len(old), len(new))]:
        if x > i or y > j:
            changes.append((i, x, j, y))
        i, j = x + 1, y + 1
    groups: list[list[tuple[int, int, int, int]]] = []
    for change in changes:
        if groups and change[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(change)
        else:
            groups.append([change])
    out = []
    for group in groups:
        low, high = max(0, group[0][0] - context), min(len(old), group[-1][1] + context)
        shift_low, shift_high = group[0][2] - group[0][0], group[-1][3] - group[-1][1]
        body, at = [], low
        for i0, i1, j0, j1 in group:
            body += [" " + x for x in old[at:i0]] + ["-" + x for x in old[i0:i1]] + ["+" + x for x in new[j0:j1]]
            at = i1
        body += [" " + x for x in old[at:high]]
        new_low, new_high = low + shift_low, high + shift_high
        spans = [f"{lo + (hi > lo)},{hi - lo}" for lo, hi in ((low, high), (new_low, new_high))]
        lines = [f"@@ -{spans[0]} +{spans[1]} @@"]
        for x in body:
            lines += [x[:-1]] if x.endswith("\n") else [x, NO_END]
        out.append(lines)
    return out


def _quoted(path: str) -> str:
    return '"' + path.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"' \
        if re.search(r'["\\\n\t]', path) else path


def unified(path: str, old: str | None, new: str | None, context: int = CONTEXT) -> str:
    """Patch text; null stands for no file. Versions that are equal give ''."""
    if old == new:
        return ""
    left, right = _quoted(f"a/{path}"), _quoted(f"b/{path}")
    head = [f"diff --git {left} {right}"]
    if old is None:
        head.append("new file mode 100644")
    elif new is None:
        head.append("deleted file mode 100644")
    body = hunks(split_lines(old or ""), split_lines(new or ""), context)
    if body:  # an empty file that comes or goes has no hunks and no file lines
        head += [f"--- {'/dev/null' if old is None else left}", f"+++ {'/dev/null' if new is None else right}"]
    return "\n".join([*head, *(x for h in body for x in h)])


def applied(text: str, patch: str, reverse: bool = False) -> str:
    """The other version of a file from one version and the patch between them; an error if the patch does not fit."""
    taken, given = ("+", "-") if reverse else ("-", "+")
    old, out, at = split_lines(text), [], 0
    lines = patch.split("\n")
    k = next((i for i, x in enumerate(lines) if HEADER.match(x)), len(lines))
    while k < len(lines):
        a, n, b, m = (1 if x is None else int(x) for x in HEADER.match(lines[k]).groups())
        start, left, right = (b, m, n) if reverse else (a, n, m)
        begin = start - 1 if left else start
        out += old[at:begin]
        at, k = begin, k + 1
        while left or right or (k < len(lines) and lines[k].startswith("\\")):
            sign, line = lines[k][:1], lines[k][1:]
            ends = k + 1 < len(lines) and lines[k + 1].startswith("\\")
            full = line if ends else line + "\n"
            if sign != given:
                if at >= len(old) or old[at] != full:
                    raise ValueError("the patch does not fit the text")
                at, left = at + 1, left - 1
            if sign != taken:
                out.append(full)
                right -= 1
            k += 2 if ends else 1
    return "".join([*out, *old[at:]])


def change_type(old: Column, new: Column) -> Column:
    """A (added), D (deleted), M (changed), or null where the versions are equal."""
    return F.when(old.eqNullSafe(new), F.lit(None)).when(old.isNull(), "A").when(new.isNull(), "D").otherwise("M")


def version_patch(path: Column, old: Column, new: Column, context: int = CONTEXT) -> Column:
    """Unified patch from one version of a file to the next: added (old is null), deleted (new is null) or changed.

    Equal versions give an empty text; a null path is the empty path.
    """
    def make(paths: pa.Array, olds: pa.Array, news: pa.Array) -> pa.Array:
        return pa.array([unified(p or "", a, b, context) for p, a, b in zip(
            paths.to_pylist(), olds.to_pylist(), news.to_pylist())], pa.string())

    return F.arrow_udf(make, "string")(path, old, new)


def patched(text: Column, patch: Column, reverse: bool = False) -> Column:
    """The text after a patch of one file, or with `reverse` before it; null texts count as empty, null patches change nothing."""
    def make(texts: pa.Array, patches: pa.Array) -> pa.Array:
        return pa.array([applied(t or "", p or "", reverse) for t, p in zip(texts.to_pylist(), patches.to_pylist())], pa.string())

    return F.arrow_udf(make, "string")(text, patch)
