"""SuperMinHash near duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from diffscope.llm import near_dedup, queries
from diffscope.llm.near_dedup import band_keys, near_duplicates, super_minhash
from diffscope.llm.words import BlockHasher, Hasher, chunks, mixed
from tests.llm import cases


def one_by_one(elements, m):
    """The published algorithm: one element after the other, histogram of steps for the early stop."""
    top = 1 << 63
    h, counts, last = [top] * m, [0] * m, m - 1
    counts[m - 1] = m
    for x in elements:
        p = list(range(m))
        step = 0
        while step <= last:
            u = int(mixed(np.array([x], dtype=np.uint64), 1000 + step)[0])
            k = step + ((u & 0xFFFFFFFF) * (m - step) >> 32)
            p[step], p[k] = p[k], p[step]
            rank = (step << 32) | (u >> 32)
            if rank < h[p[step]]:
                old = min(h[p[step]] >> 32, m - 1)
                h[p[step]] = rank
                if step < old:
                    counts[old] -= 1
                    counts[step] += 1
                    while counts[last] == 0:
                        last -= 1
            step += 1
    return h


@pytest.mark.parametrize("m", [8, 150, 300])
def test_signatures_are_those_of_the_algorithm(m):
    rng = np.random.default_rng(m)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 40, 1, 900)]
    assert super_minhash(sets, m).tolist() == [one_by_one(s, m) for s in sets]


def test_estimates_vary_less_than_independent_ranks():
    rng, m, errors = np.random.default_rng(3), 150, []
    for _ in range(150):
        a = rng.integers(0, 2**63, 60, dtype=np.uint64)
        b = np.concatenate((a[:40], rng.integers(0, 2**63, 20, dtype=np.uint64)))
        x, y = super_minhash([a, b], m)
        errors.append((x == y).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.8 * 0.25 / m


def test_bands():
    rng = np.random.default_rng(1)
    s = super_minhash([rng.integers(0, 2**63, 90, dtype=np.uint64) for _ in range(5)], 150)
    keys = band_keys(s, 30, 5)
    assert keys.shape == (5, 30) and len(np.unique(keys)) == 150
    s[1, 5:10] = s[0, 5:10]
    assert (band_keys(s, 30, 5)[0] == band_keys(s, 30, 5)[1]).tolist() == [i == 1 for i in range(30)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    chain = cases.prose(rng, 80).split()
    more = []
    for i in range(40):  # each near the one before, the ends far apart; ids in another order
        chain = list(chain)
        chain[rng.randrange(80)] = f"y{i}"
        more.append((9000 + (i * 17) % 40, " ".join(chain)))
    return cases.documents() + more


@pytest.mark.parametrize("k, share, block", [(3, 85, (512, 200_000)), (3, 85, (2, 300)), (5, 75, (4, 200_000))])
def test_groups(spark, rows, k, share, block):
    queries.configure(spark)
    bands, per_band = (30, 5) if share == 85 else (43, 4)
    found = near_duplicates(cases.table(spark, rows), n=k, threshold=(share, 100), bands=bands, rows=per_band, block=block)
    got = sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in found.collect())
    assert got == sorted(repr((i, n, c, i == c)) for i, n, _, c in cases.linked(rows, k, share))


def test_lists_with_a_centre_that_no_member_is_near(spark):
    """Members linked with each other but not with the least member of their lists are still found."""
    rng = random.Random(2)
    common = cases.prose(rng, 60)
    rows = [(i, f"{common} {cases.prose(rng, 40)}") for i in range(30)]
    rows += [(100 + i, f"{t} end{i}") for i, (_, t) in enumerate(rows)]
    found = near_duplicates(cases.table(spark, rows), n=3, threshold=(85, 100), bands=300, rows=1, block=(4, 500))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == sorted((i, i % 100) for i, _ in rows)


def test_empty(spark):
    assert near_duplicates(cases.table(spark, []).limit(0)).count() == 0
    assert [tuple(r) for r in near_duplicates(cases.table(spark, [(None, None), (4, " ")])).select(
        "doc_id", "n_shingles", "component_id", "kept").orderBy("doc_id").collect()] == [(None, 0, None, True), (4, 0, 4, True)]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_in_patterns_do_not_meet():
    words = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), "a" * 8, "a" * 9, "ab" * 4, "a", "A", "é", "x" * 16, "x" * 24]
    _, data, offsets = next(chunks(pa.array([" ".join(words)])))
    h = BlockHasher().words(data, offsets).hash
    assert len(set(h.tolist())) == len(words)
    assert BlockHasher(fold=True).words(data, offsets).hash[5] == BlockHasher(fold=True).words(data, offsets).hash[6]


def test_block_hashes_find_the_same_words(rows):
    for low, data, offsets in chunks(pa.array([t for _, t in rows], pa.string()), 700):
        a, b = Hasher(fold=True).words(data, offsets), BlockHasher(fold=True).words(data, offsets)
        assert np.array_equal(a.start, b.start) and np.array_equal(a.end, b.end) and np.array_equal(a.first, b.first)
        assert len(set(zip(a.hash.tolist(), b.hash.tolist()))) == len(set(a.hash.tolist())) == len(set(b.hash.tolist()))
