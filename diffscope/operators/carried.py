"""The last marked row of a group carried to the rows after it, with one exchange of the rows.

Rows are dealt by range of (group, order) and sorted, so a group that holds a third of all rows spreads over as many
partitions as its share needs. One streaming pass per partition hands the values of the last marked row on. Rows at the
head of a partition whose group began in an earlier one stay open; each partition ends with a summary of one row, the
values it hands on, and the open rows take those of the nearest earlier partition with the same group. Only summaries and
open rows are joined.

A window function would need the whole group in one task; joins on ranges would exchange contents twice.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffscope.session import written

ROW, HEAD, TAIL = 0, 1, 2


def carried(rows: DataFrame, by: list[str], order: list[Column], marked: str, values: list[str],
            before: bool = False) -> DataFrame:
    """`rows` with last_<value>: the values of the last row, in `order`, whose column `marked` is true, of the same group.

    `order` starts with the columns of `by`. A marked row sees itself, or with `before` the one before it. Null groups are
    groups; without a marked row at or before it, a row gets nulls. Rows that tie in `order` are taken in any order: give
    an order that tells apart what matters.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [*rows.columns, *[f"last_{v}" for v in values], "_kind", "_part", "_open"]
    key_at, mark_at = [rows.columns.index(k) for k in by], rows.columns.index(marked)
    value_at = [rows.columns.index(v) for v in values]

    def run(batches):
        part, first, key, source, opened, empty = TaskContext.get().partitionId(), None, None, None, False, None
        for b in batches:
            if not b.num_rows:
                continue
            empty = b.slice(0, 0)
            keys = list(zip(*(b.column(i).to_pylist() for i in key_at)))
            marks = b.column(mark_at).to_pylist()
            if first is None:
                first, key, opened = b.slice(0, 1), keys[0], True
            held = 0 if source is not None else None  # 0: the row carried from an earlier batch, i + 1: row i
            take, open_rows = [], []
            for i, (k, m) in enumerate(zip(keys, marks)):
                if k != key:
                    key, held, opened = k, None, False
                if before:
                    take.append(held)
                    open_rows.append(opened)
                if m:
                    held, opened = i + 1, False
                if not before:
                    take.append(held)
                    open_rows.append(opened)
            at = pa.array(take, pa.int64())
            last = []
            for n, i in enumerate(value_at):
                carry = source[n] if source is not None else pa.nulls(1, b.column(i).type)
                last.append(pa.concat_arrays([carry, b.column(i)]).take(at))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *last, pa.array([ROW] * b.num_rows, pa.int32()), pa.array([part] * b.num_rows, pa.int32()),
                 pa.array(open_rows, pa.bool_())], names)
            if held is None:
                source = None
            elif held:
                source = [pa.concat_arrays([b.column(i).slice(held - 1, 1)]) for i in value_at]
            tail = b.slice(b.num_rows - 1, 1)
        if first is None:
            return
        for kind, row in ((HEAD, first), (TAIL, tail)):
            if kind == TAIL and source is None:
                continue
            only = [c if i in key_at else pa.nulls(1, c.type) for i, c in enumerate(row.columns)]
            last = source if kind == TAIL else [pa.nulls(1, empty.column(i).type) for i in value_at]
            yield pa.RecordBatch.from_arrays(
                [*only, *last, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([False])], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    lasts = "".join(f", `last_{v}` {rows.schema[v].dataType.simpleString()}" for v in values)
    passed = written(sorted_rows.mapInArrow(run, f"{kinds}{lasts}, _kind int, _part int, _open boolean"))

    # for each partition's first group, the nearest earlier partition that hands a row of that group on
    ends = passed.where(F.col("_kind") != ROW).select(*by, "_kind", "_part")
    earlier = Window.partitionBy(*by).orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    source_of = ends.withColumn("_from", F.last(F.when(F.col("_kind") == TAIL, F.col("_part")), True).over(earlier)).where(
        (F.col("_kind") == HEAD) & F.col("_from").isNotNull()).select("_part", "_from")
    handed = passed.where(F.col("_kind") == TAIL).select(
        F.col("_part").alias("_from"), *[F.col(f"last_{v}").alias(f"_handed_{v}") for v in values])
    handed = source_of.join(handed, "_from").drop("_from")

    mine = passed.where(F.col("_kind") == ROW)
    kept = [F.col(f"`{c}`") for c in rows.columns]
    settled = mine.where("NOT _open").select(*kept, *[f"last_{v}" for v in values])
    late = mine.where("_open").join(handed, "_part", "left").select(
        *kept, *[F.coalesce(f"last_{v}", f"_handed_{v}").alias(f"last_{v}") for v in values])
    return settled.unionByName(late)
