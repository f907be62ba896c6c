"""Labelled samples, one-task fits and scoring shared by the two text classifiers."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.llm.store import Files, shared_folder, written

PER_CLASS = 4000


def bucket(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`."""
    return F.crc32(key.cast("string").cast("binary")) % of


def sample(documents: DataFrame, labels: DataFrame, label: str, of: int, held_out: int, per_class: int,
           id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(text, label, rank) of at most `per_class` training rows of each label, and the share of label 1 in all of them.

    The rows are those with the least hashes of their ids. Null labels are left out; a document with several labels has
    the largest; of several texts with one id the least is taken.
    """
    train = written(labels.where(F.col(label).isNotNull() & (bucket(F.col(id_col), of) != held_out)).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label")), "training-labels")
    ones, rows = train.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    rank = F.xxhash64("id")
    some = train.where("label = 0").orderBy(rank, "id").limit(per_class).unionByName(
        train.where("label = 1").orderBy(rank, "id").limit(per_class))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(some), "id").groupBy("id", "label").agg(  # at most 2 x per_class rows
        F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return joined.select("text", "label", F.xxhash64("id").alias("rank")), (ones + 1) / (rows + 2)


def fitted(rows: DataFrame, share: float, fit: Callable[[list[str], np.ndarray], dict[str, np.ndarray]]) -> str:
    """Run `fit(texts, labels)` on the bounded sample in one task; the folder of the model file.

    The model gets `share`, the label's share in all training rows; with fewer than two labels it is only that.
    """
    folder = shared_folder(rows.sparkSession, "model")
    Files(folder).make()

    def run(batches):
        held = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (2, 1, 0)))]
        held.sort()
        labels = np.array([r[1] for r in held], dtype=np.int64)
        model = {"share": np.array([share])}
        if len(set(labels.tolist())) == 2:
            # the sample has its own share of label 1: move the intercept to that of all training rows
            shift = np.log(share / (1 - share)) - np.log(labels.mean() / (1 - labels.mean()))
            model |= fit([r[2] for r in held], labels) | {"shift": np.array([shift])}
        out = io.BytesIO()
        np.savez(out, **model)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    if found is None:  # no labelled rows
        found = {"model": next(run([])).column(0)[0].as_py()}
    Files(folder).write("model.npz", bytes(found["model"]))
    return folder


def scored(documents: DataFrame, folder: str, scorer: Callable[[dict], Callable[[pa.Array], np.ndarray]],
           id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, keep_*): `scorer(model)` gives log-odds of texts, before the shift to all training rows."""

    def run(batches):
        model = dict(np.load(io.BytesIO(Files(folder).read("model.npz"))))
        odds = scorer(model) if "shift" in model else None
        for b in batches:
            if odds is None:
                score = np.full(b.num_rows, model["share"][0])
            else:
                x = np.clip(odds(b.column(1)) + model["shift"][0], -500, 500)
                score = 1 / (1 + np.exp(-x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), *b.columns[2:]],
                                             ["doc_id", "score", *[f"keep_{c}" for c in keep]])

    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    more = "".join(f", keep_{c} {fields[c]}" for c in keep)
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[
        F.col(c).alias(f"keep_{c}") for c in keep]).mapInArrow(run, f"doc_id {fields[id_col]}, score double" + more)


def digest(scores: DataFrame, of: int, held_out: int, least: float) -> DataFrame:
    """The query's columns."""
    return scores.select("doc_id", F.coalesce(bucket(F.col("doc_id"), of) == held_out, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= least).cast("int").alias("predicted"))
