"""Quality: logistic regression of hashed word n-grams, fitted by follow-the-regularised-leader updates.

Tokens are runs of letters and digits and runs of punctuation. Features are their one- and two-grams in lower case, and
the one- to three-grams of their forms (lower, capitalised, upper, digits, mixed, the punctuation itself, or "as before"
for a word that repeats the one before it), hashed into 2^20 cells. A feature's value is 1 + log(count), divided by the
norm of the text's values. A score is a sparse dot product. Fitting uses at most `per_class` rows of each label (a
bounded, deterministic sample of the training rows); scoring reads every text whole, in one pass, without a shuffle.

Defined cases: null text is empty text, and gets the score of the intercept; repeated rows get equal scores; without two
labels in the training rows every score is the smoothed share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from diffscope.llm import training
from diffscope.llm.words import WHITE_SPACE, Hasher, Words, chunks, mixed

BITS = 20
OF, HELD_OUT, LEAST = 3, 1, 0.5  # folds and threshold of the query
SPACE, WORD, MARK = 0, 1, 2


class Features:
    def __init__(self, bits: int = BITS):
        self.hasher = Hasher(fold=True)
        self.shift = np.uint64(64 - bits)
        kind = np.full(256, MARK, dtype=np.uint8)
        kind[list(WHITE_SPACE)] = SPACE
        for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
            kind[low:high] = WORD
        self.kind = kind
        letter = np.zeros((256, 3), dtype=np.int64)  # counts of lower-case, upper-case and digit bytes
        letter[97:123, 0] = letter[128:, 0] = letter[65:91, 1] = letter[48:58, 2] = 1
        self.letter = letter

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """Tokens of texts, and a hash of each token's form."""
        n = len(data)
        if n == 0:
            return self.hasher.words(data, offsets), np.zeros(0, dtype=np.uint64)
        kind = self.kind[data]
        edge = np.concatenate(([True], kind[1:] != kind[:-1]))
        edge[offsets[offsets < n]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)
        some = kind[start] != SPACE
        start, end = start[some], end[some]
        power, inverse = self.hasher._powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hasher.value[data] * power[:n], out=sums[1:])
        h = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64), 2)
        words = Words(start, end, h, np.searchsorted(start, offsets))
        counts = np.zeros((n + 1, 3), dtype=np.int32)
        np.cumsum(self.letter[data], axis=0, out=counts[1:])
        low, up, digit = (counts[end] - counts[start]).T
        first_up = self.letter[data[start], 1] == 1
        form = np.select([digit == end - start, (low == 0) & (digit == 0) & (up > 1), first_up & (up == 1) & (digit == 0),
                          (up == 0) & (digit == 0)], [1, 2, 3, 4], 5).astype(np.uint64)
        form = mixed(form, 50)
        mark = kind[start] == MARK
        form[mark] = h[mark]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & ~mark[1:]))
        again[words.first[:-1][words.first[:-1] < len(h)]] = False
        form[again] = mixed(np.array([6], dtype=np.uint64), 50)
        return words, form

    def of(self, texts: pa.Array):
        """For each text its cells and their values."""
        for _, data, offsets in chunks(texts):
            words, form = self.tokens(data, offsets)
            forms = Words(words.start, words.end, form, words.first)
            streams = [self.hasher.grams(w, k, salt) for w, salt, most in ((words, 60, 2), (forms, 61, 3))
                       for k in range(1, most + 1)]
            cells = [(at, (h >> self.shift).astype(np.int64)) for at, h in streams]
            cuts = [np.searchsorted(at, words.first) for at, _ in cells]
            for d in range(len(offsets) - 1):
                found, count = np.unique(np.concatenate([c[cut[d]:cut[d + 1]] for (_, c), cut in zip(cells, cuts)]),
                                         return_counts=True)
                value = 1 + np.log(count)
                yield found, value / max(1e-9, np.sqrt((value * value).sum()))


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS, passes: int = 6, alpha: float = 0.5, beta: float = 1.0,
        l1: float = 1e-3, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights by FTRL-proximal updates, one text after the other. The last weight is the intercept's."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = [(np.append(c, size), np.append(v, 1.0)) for c, v in Features(bits).of(pa.array(texts, pa.string()))]

    def weight(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    random = np.random.default_rng(7)
    for _ in range(passes):
        for i in random.permutation(len(rows)).tolist():
            cells, values = rows[i]
            w = weight(z[cells], n[cells])
            p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
            g = (p - labels[i]) * values
            sigma = (np.sqrt(n[cells] + g * g) - np.sqrt(n[cells])) / alpha
            z[cells] += g - sigma * w
            n[cells] += g * g
    return {"weights": weight(z, n).astype(np.float32)}


def scorer(model: dict):
    weights = model["weights"]
    features = Features(int(len(weights) - 1).bit_length() - 1)

    def odds(texts: pa.Array) -> np.ndarray:
        return np.array([weights[c] @ v for c, v in features.of(texts)], dtype=np.float64) + weights[-1]

    return odds


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", of: int = OF, held_out: int = HELD_OUT,
          per_class: int = training.PER_CLASS) -> str:
    """Fit on the labelled rows outside the held-out fold: the folder of the model."""
    return training.fitted(*training.sample(documents, labels, label, of, held_out, per_class), fit)


def scores(documents: DataFrame, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return training.scored(documents, folder, scorer, keep=keep)
