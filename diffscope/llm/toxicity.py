"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased, what is neither letter nor digit becomes a space. Its features are the distinct runs of four to
six characters, hashed into 2^20 cells. A cell's scale is the logarithm of the ratio of its smoothed shares in the two
labels; a logistic regression is fitted on the scaled features by mini-batch gradient steps. Fitting uses
at most `per_class` rows of each label (a bounded, deterministic sample of the training rows); scoring reads every text
whole, in one pass, without a shuffle.

Defined cases: null text is empty text, and gets the score of the intercept; repeated rows get equal scores; without two
labels in the training rows every score is the smoothed share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from diffscope.llm import training
from diffscope.llm.words import GAMMA, MULTIPLIER

BITS = 20
SIZES = (4, 5, 6)
OF, HELD_OUT, LEAST = 4, 2, 0.3  # folds and threshold of the query


class Grams:
    """Distinct hashed character n-grams of texts, one text at a time."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=np.int32)
        points = np.arange(0x110000, dtype=np.uint32)
        self.code = points.copy()
        word = np.frombuffer(bytes(chr(i).isalnum() for i in range(0xD800)), dtype=np.uint8)
        self.code[:0xD800][word == 0] = 32
        lower = np.array([ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(0x600)], dtype=np.uint32)
        self.code[:0x600] = np.where(self.code[:0x600] == 32, 32, lower)

    def of(self, text: str) -> np.ndarray:
        x = self.code[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))].astype(np.uint64)  # one space for several
        found, h = [], None
        for n in range(1, max(SIZES) + 1):
            if len(x) < n:
                break
            h = x if h is None else h[:len(x) - n + 1] * np.uint64(MULTIPLIER) + x[n - 1:]
            if n in SIZES:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(GAMMA)
                found.append((mixed >> self.shift).astype(np.int32))
        if not found:
            return np.zeros(0, dtype=np.int32)
        cells = np.concatenate(found)
        order = np.arange(len(cells), dtype=np.int32)
        self.seen[cells] = order  # the last of equal cells stays
        return cells[self.seen[cells] == order]


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS, passes: int = 30, rate: float = 1.0,
        penalty: float = 1e-4, batch: int = 16, smooth: float = 1.0, errors: float = 3.0) -> dict[str, np.ndarray]:
    """Weight of each cell (its scale included) and intercept.

    A log-count ratio is pulled to zero by `errors` of its standard errors, so that cells which are in a few texts by
    chance have no scale and the fit cannot rest on them.
    """
    grams = Grams(bits)
    rows = [grams.of(t) for t in texts]
    counts = np.full((2, 1 << bits), smooth)
    for cells, y in zip(rows, labels.tolist()):
        counts[y, cells] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    doubt = errors * np.sqrt((1 / counts).sum(axis=0))
    scale = (np.sign(ratio) * np.maximum(0, np.abs(ratio) - doubt)).astype(np.float32)
    rows = [cells[scale[cells] != 0] for cells in rows]
    norm = float(np.mean([(scale[c] ** 2).sum() + 1 for c in rows]))
    weight = np.zeros(1 << bits, dtype=np.float32)
    bias = 0.0
    random = np.random.default_rng(7)
    for turn in range(passes):
        order = random.permutation(len(rows))
        step = rate / norm / (1 + turn / 4)
        for low in range(0, len(order), batch):
            some = order[low:low + batch].tolist()
            sizes = np.array([len(rows[i]) for i in some])
            cells = np.concatenate([rows[i] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            odds = np.bincount(owner, weights=weight[cells] * scale[cells], minlength=len(some)) + bias
            error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[some]
            weight *= np.float32(1 - step * penalty * len(some))
            np.subtract.at(weight, cells, (step * error[owner]).astype(np.float32) * scale[cells])
            bias -= step * float(error.sum())
    return {"weights": weight * scale, "bias": np.array([bias])}


def scorer(model: dict):
    grams = Grams(int(len(model["weights"])).bit_length() - 1)

    def odds(texts: pa.Array) -> np.ndarray:
        return np.array([model["weights"][grams.of(t or "")].sum(dtype=np.float64) for t in texts.to_pylist()]
                        ) + model["bias"][0]

    return odds


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", of: int = OF, held_out: int = HELD_OUT,
          per_class: int = training.PER_CLASS) -> str:
    """Fit on the labelled rows outside the held-out fold: the folder of the model."""
    return training.fitted(*training.sample(documents, labels, label, of, held_out, per_class), fit)


def scores(documents: DataFrame, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return training.scored(documents, folder, scorer, keep=keep)
