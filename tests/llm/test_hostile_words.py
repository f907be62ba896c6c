"""Long words that a polynomial hash cannot tell apart, compressed planes, the rarity table, cuts and candidate terms."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from diffscope.llm import decontaminate, imatch, ngram_join, ranges, substring_dedup, wavelet
from diffscope.llm.store import Files
from diffscope.llm.words import BlockHasher, Hasher, chunks
from tests.llm import cases
from tests.llm.test_near_dedup import thue_morse
from tests.llm.test_operators import TOKENIZER

ONE, TWO = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_hashes_of_the_two_words():
    _, data, offsets = next(chunks(pa.array([f"{ONE} {TWO}"])))
    assert len(set(Hasher().words(data, offsets).hash.tolist())) == 1  # what must not decide
    assert len(set(BlockHasher().words(data, offsets).hash.tolist())) == 2


def test_encoder_keeps_them_apart():
    texts = [ONE, TWO, f"{TWO} {ONE}"]
    encoder, tokenizer = wavelet.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    _, data, offsets = next(chunks(pa.array(texts)))
    ids, counts = encoder.encode(data, offsets, 2)
    expected = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [x for e in expected for x in e] and counts.tolist() == [len(e) for e in expected]


def test_operators_keep_them_apart(spark):
    words = [f"w{i}" for i in range(30)]
    first, second = " ".join([*words, ONE, *words[::-1]]), " ".join([*words[5:], TWO, *words[::-1][:25]])
    docs = cases.table(spark, [(1, ONE), (2, TWO), (3, first), (4, f"x {ONE} y z"), (5, f"x {TWO} y z"), (6, second)])
    joined = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs).collect()}
    assert joined[1] == 1 and joined[2] == 2 and joined[4] == 4 and joined[5] == 5
    kept = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    words_of = {i: t.split() for i, t in [(3, first), (6, second)]}
    seen = {tuple(words_of[3][i:i + 20]) for i in range(len(words_of[3]) - 19)}
    gone = {i + j for i in range(len(words_of[6]) - 19) if tuple(words_of[6][i:i + 20]) in seen for j in range(20)}
    assert kept[6].n_removed == len(gone) and kept[3].n_removed == 0 and TWO in [
        w for i, w in enumerate(words_of[6]) if i not in gone]
    items = spark.createDataFrame([("a", ONE), ("b", f"y z {ONE}")], "item_id string, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()}
    assert hits == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0}
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs).collect()}
    assert prints[1] != prints[2]


@pytest.mark.parametrize("n", [1, 65_535, 65_536, 65_537, 300_000])
def test_planes_in_blocks(n):
    rng = np.random.default_rng(n)
    x = rng.choice(np.arange(40_000, dtype=np.uint16), n, p=(w := 1 / np.arange(1, 40_001)) / w.sum())
    x[n // 3:n // 2] = 7  # blocks of one value are nearly empty when compressed
    built = wavelet.WaveletMatrix.build(x, 16)
    data = b"".join(built.to_bytes([1], np.array([n])))
    matrix = wavelet.WaveletMatrix.from_bytes(data)[0]
    assert (matrix.decode() == x).all()
    for i in {0, n // 2, n - 1, min(n - 1, 65_536)}:
        assert matrix.access(i) == x[i] and matrix.rank(int(x[i]), i) == (x[:i] == x[i]).sum()
        at = np.flatnonzero(x == x[i])
        assert (matrix.occurrences(int(x[i])) == at).all()
        assert matrix.select(int(x[i]), len(at) - 1) == at[-1]
    if n == 300_000:
        assert len(data) < 0.8 * 2 * n


def test_planes_open_one_block_each(monkeypatch):
    x = np.random.default_rng(1).integers(0, 50, 500_000).astype(np.uint16)
    matrix = wavelet.WaveletMatrix.from_bytes(b"".join(wavelet.WaveletMatrix.build(x, 6).to_bytes([1], np.array([len(x)]))))[0]
    opened, block = [], wavelet.Plane.block
    monkeypatch.setattr(wavelet.Plane, "block", lambda self, i: opened.append((id(self), i)) or block(self, i))
    assert matrix.access(400_000) == x[400_000] and len(set(opened)) <= 2 * 6  # the bit's block, and where its rank ends


def test_rarity_is_the_count_of_all_shingles(spark, monkeypatch):
    rng = random.Random(4)
    texts = [cases.prose(rng, 30) for _ in range(40)]
    texts += texts[:10]
    docs = cases.table(spark, list(enumerate(texts)), 3)
    monkeypatch.setattr(ngram_join, "CELL_BITS", (18, 18))
    monkeypatch.setattr(ngram_join, "HELD_CELLS", 100)
    folder, mean = ngram_join._rarity(docs, 2, 1000)
    ranks = np.frombuffer(Files(folder).read("ranks"), dtype=np.uint8)
    hasher = BlockHasher(fold=True)
    per_task = docs.select(F.spark_partition_id().alias("p"), "text").collect()
    counts = np.zeros(1 << 18)
    for _, t in {(r.p, r.text) for r in per_task}:  # copies inside a task count once
        for s in ngram_join.shingles(hasher, pa.array([t]), 2):
            np.add.at(counts, (s >> np.uint64(46)).astype(np.int64), 1)
    assert (ranks == np.rint(4 * np.log2(counts + 1))).all() and mean == pytest.approx((counts ** 2).sum() / counts.sum())


def test_rarity_in_the_largest_table_sends_what_was_counted(spark, monkeypatch):
    docs = cases.table(spark, [(i, f"a{i} b c d e f g") for i in range(50)], 4)
    monkeypatch.setattr(ngram_join, "CELL_BITS", (26, 26))
    ranks = np.frombuffer(Files(ngram_join._rarity(docs, 5, 1000)[0]).read("ranks"), dtype=np.uint8)
    assert len(ranks) == 1 << 26 and Counter(ranks[ranks > 0].tolist()) == {4: 50, round(4 * np.log2(51)): 2}


def test_cuts_with_a_third_of_rows_on_one_key(spark, monkeypatch):
    sizes = spark.range(9000).select(F.when(F.col("id") % 3 == 0, ranges.LAST).otherwise(F.col("id")).alias("place"),
                                     F.lit(100).cast("long").alias("bytes"))
    whole = ranges.cuts(sizes, 30_000)
    assert 18 <= len(whole) <= 22 and (np.diff(whole) > 0).all() and whole[-1] == ranges.LAST
    monkeypatch.setattr(ranges, "MOST", 500)
    some = ranges.cuts(sizes.repartition(7), 30_000)
    assert some.tolist() == ranges.cuts(sizes, 30_000).tolist() and len(some) >= 15


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_candidates_are_bounded_and_hold_the_lexicon(spark, parts):
    rng = random.Random(8)
    rows = [(i, cases.prose(rng, 40)) for i in range(200)]
    docs = cases.table(spark, rows, parts)
    found = {r.term for r in imatch._candidates(docs.select("text"), 0.1, len(rows)).collect()}
    counts = Counter(w for _, t in rows for w in set(t.lower().split()))
    hasher = BlockHasher(imatch.NOT_ALPHANUMERIC, fold=True)
    names = sorted(counts)
    _, data, offsets = next(chunks(pa.array([" ".join(names)])))
    terms = dict(zip(names, hasher.words(data, offsets).hash.view(np.int64).tolist()))
    assert {terms[w] for w, c in counts.items() if c >= 20} <= found
    assert found <= {terms[w] for w, c in counts.items() if c >= 10}
