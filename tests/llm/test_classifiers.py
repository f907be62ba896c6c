"""The two classifiers and the fingerprints against plain Python: features, scales, updates, scores, parts and likeness."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from diffscope.llm import imatch, quality, queries, toxicity
from diffscope.llm.words import FINAL, GAMMA, MULTIPLIER
from tests.llm import cases

ALL = (1 << 64) - 1


def mix(x, salt=0):
    x = (x + salt * MULTIPLIER) & ALL
    x = ((x ^ (x >> 30)) * GAMMA) & ALL
    x = ((x ^ (x >> 27)) * FINAL) & ALL
    return x ^ (x >> 31)


TEXTS = ["", "A", "ab", "  Héllo,   WORLD 42!! ", "Ünïcode straße ẞ ΑΒΓ x", "line one\nline two\tx", "¿qué? ¡sí!", "aaaaaaa", "a-b_c",
         "日本語 text", "The the THE tHe 1st 22 U.S. NASA", "!!! ... ??", "x" * 300] + [t for _, t in cases.documents(copies=3) if t]


# ------------------------------------------------------------------ toxicity

def character_cells(text, bits):
    plain = "".join(c.lower() if c.isalnum() and ord(c) < 0x600 and len(c.lower()) == 1 else c if c.isalnum() or ord(c) >= 0xD800
                    else " " for c in f" {text} ")
    plain = re.sub(" +", " ", plain)
    found = set()
    for n in (4, 5, 6):
        for i in range(len(plain) - n + 1):
            h = 0
            for c in plain[i:i + n]:
                h = (h * MULTIPLIER + ord(c)) & ALL
            found.add((((h ^ (h >> 29)) * GAMMA) & ALL) >> (64 - bits))
    return found


def test_character_cells():
    grams = toxicity.Grams(14)
    for text in TEXTS:
        cells = grams.of(text).tolist()
        assert len(cells) == len(set(cells)) and set(cells) == character_cells(text, 14)


def labelled(n=60):
    rng = random.Random(4)
    words = [[cases.prose(rng, 1) for _ in range(30)] for _ in range(3)]
    rows = [(" ".join(rng.choice(words[y] + words[2]) for _ in range(rng.randint(3, 25))), y)
            for y in (rng.randint(0, 1) for _ in range(n))]
    return [t for t, _ in rows], np.array([y for _, y in rows])


def plain_toxicity(texts, labels, bits, passes, rate, penalty, batch, smooth, errors):
    rows = [character_cells(t, bits) for t in texts]
    size = 1 << bits
    counts = [[smooth] * size for _ in range(2)]
    for cells, y in zip(rows, labels):
        for c in cells:
            counts[y][c] += 1
    sums = [sum(c) for c in counts]
    scale = []
    for c in range(size):
        ratio = math.log(counts[1][c] / sums[1]) - math.log(counts[0][c] / sums[0])
        doubt = errors * math.sqrt(1 / counts[0][c] + 1 / counts[1][c])
        scale.append(math.copysign(max(0.0, abs(ratio) - doubt), ratio))
    rows = [[c for c in cells if scale[c]] for cells in rows]
    norm = sum(sum(scale[c] ** 2 for c in cells) + 1 for cells in rows) / len(rows)
    weight, bias = [0.0] * size, 0.0
    order_of = np.random.default_rng(7)
    for turn in range(passes):
        order = order_of.permutation(len(rows)).tolist()
        step = rate / norm / (1 + turn / 4)
        for low in range(0, len(order), batch):
            some = order[low:low + batch]
            error = {}
            for i in some:
                odds = bias + sum(weight[c] * scale[c] for c in rows[i])
                error[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) - labels[i]
            shrink = 1 - step * penalty * len(some)
            weight = [w * shrink for w in weight]
            for i in some:
                for c in rows[i]:
                    weight[c] -= step * error[i] * scale[c]
            bias -= step * sum(error.values())
    return [bias + sum(weight[c] * scale[c] for c in cells) for cells in rows]


def test_toxicity_is_the_stated_regression():
    texts, labels = labelled()
    options = dict(bits=10, passes=4, rate=1.0, penalty=1e-4, batch=16, smooth=1.0, errors=0.5)
    model = toxicity.fit(texts, labels, **options)
    odds = toxicity.scorer(model)(pa.array(texts))
    expected = plain_toxicity(texts, labels.tolist(), **options)
    assert np.abs(expected).max() > 0.3 and np.allclose(odds, expected, atol=2e-4)
    assert ((odds > 0) == (labels == 1)).mean() > 0.9


# ------------------------------------------------------------------ quality

def tokens(text):
    return [m for m in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\x20\x09-\x0D]+", text)]


def polynomial(raw):
    value = 0
    for i, b in enumerate(raw):
        value = (value + mix(b, 1) * pow(MULTIPLIER, i, 1 << 64)) & ALL
    return value


def token_hash(token):
    raw = cases.fold(token).encode()
    return mix((polynomial(raw) + len(raw)) & ALL, 2)


def token_form(token, before):
    h = token_hash(token)
    if not re.match(r"[0-9A-Za-z\u0080-\U0010ffff]", token):
        return h
    if before is not None and token_hash(before) == h:
        return mix(6, 50)
    raw = token.encode()
    digit = sum(48 <= b < 58 for b in raw)
    up = sum(65 <= b < 91 for b in raw)
    low = len(raw) - digit - up
    first_up = 65 <= raw[0] < 91
    kind = (1 if digit == len(raw) else 2 if low == 0 and digit == 0 and up > 1 else
            3 if first_up and up == 1 and digit == 0 else 4 if up == 0 and digit == 0 else 5)
    return mix(kind, 50)


def gram_hash(hashes, k, salt):
    value = 0
    for i, h in enumerate(hashes):
        value = (value + mix(h, salt) * pow(MULTIPLIER, i, 1 << 64)) & ALL
    return mix(value, k)


def word_cells(text, bits):
    found = tokens(text)
    words = [token_hash(t) for t in found]
    forms = [token_form(t, found[i - 1] if i else None) for i, t in enumerate(found)]
    cells = Counter()
    for hashes, salt, most in ((words, 60, 2), (forms, 61, 3)):
        for k in range(1, most + 1):
            for i in range(len(hashes) - k + 1):
                cells[gram_hash(hashes[i:i + k], k, salt) >> (64 - bits)] += 1
    values = {c: 1 + math.log(n) for c, n in cells.items()}
    norm = max(1e-9, math.sqrt(sum(v * v for v in values.values())))
    return {c: v / norm for c, v in values.items()}


def test_word_cells():
    for text, (cells, values) in zip(TEXTS, quality.Features(16).of(pa.array(TEXTS))):
        expected = word_cells(text, 16)
        assert cells.tolist() == sorted(expected)
        assert np.allclose(values, [expected[c] for c in sorted(expected)])


def test_quality_is_follow_the_regularised_leader():
    texts, labels = labelled()
    bits, passes, alpha, beta, l1, l2 = 10, 3, 0.5, 1.0, 1e-2, 1e-3
    model = quality.fit(texts, labels, bits, passes, alpha, beta, l1, l2)
    size = 1 << bits
    rows = [{**word_cells(t, bits), size: 1.0} for t in texts]
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(c):
        return 0.0 if abs(z[c]) <= l1 else -(z[c] - math.copysign(l1, z[c])) / ((beta + math.sqrt(n[c])) / alpha + l2)

    order_of = np.random.default_rng(7)
    for _ in range(passes):
        for i in order_of.permutation(len(rows)).tolist():
            w = {c: weight(c) for c in rows[i]}
            odds = sum(w[c] * v for c, v in rows[i].items())
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            for c, v in rows[i].items():
                g = (p - labels[i]) * v
                z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / alpha * w[c]
                n[c] += g * g
    expected = np.array([weight(c) for c in range(size + 1)])
    assert np.allclose(model["weights"], expected, atol=1e-5) and (expected == 0).any()
    odds = quality.scorer(model)(pa.array(texts))
    assert np.allclose(odds, [sum(expected[c] * v for c, v in r.items()) for r in rows], atol=1e-4)
    assert ((odds > 0) == (labels == 1)).mean() > 0.9


# ------------------------------------------------------------------ fingerprints

def blocks(word):
    value = 0
    for i in range(0, len(word), 8):
        part = word[i:i + 8]
        value += mix(((int.from_bytes(part, "little") << 8 * (8 - len(part))) + (i // 8 + 1) * MULTIPLIER) & ALL)
    return mix((value + len(word)) & ALL, 2)


def terms(text):
    return sorted({blocks(w.encode()) for w in cases.alphanumeric(text)})


def sequence(sorted_terms):
    value = 0
    for i, t in enumerate(sorted_terms):
        value = (value + mix(t, 40) * pow(MULTIPLIER, i + 1, 1 << 64)) & ALL
    return mix(value, 41) if sorted_terms else 0


def plain_fingerprint(text, lexicon):
    mine = terms(text)
    inside = [t for t in mine if t in lexicon]
    whole = sequence(inside) or sequence(mine)
    parts = []
    for k in range(imatch.PARTS):
        rate = imatch.RATES[k // imatch.PER_RATE]
        found = sequence([t for t in inside if mix(t, 1000 + k) < 2**64 // rate])
        parts.append((found >> 40 | 1) if found else 0)
    return whole, parts


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    either = [(x, y) for x, y in zip(a[1], b[1]) if x or y]
    return sum(x == y for x, y in either) / len(either) if either else 0.0


def form(print_):
    return f"{print_[0]:016x}" + "".join(f"{p:06x}" for p in print_[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprints_parts_and_likeness(spark, seed):
    queries.configure(spark)
    rng = random.Random(seed)
    vocabulary = [cases.prose(rng, 1) for _ in range(400)]
    rows = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 60)))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(30)] + [(300, None), (301, ""), (302, rows[3][1])]
    least, most = 0.02, 0.3
    held = [set(terms(t)) for _, t in rows]
    counts = Counter(t for s in held for t in s)
    lexicon = {t for t, c in counts.items() if max(2.0, least * len(rows)) <= c <= max(2.0, most * len(rows))}
    assert len(lexicon) > 50
    found = {r.doc_id: r for r in imatch.edited_fingerprints(cases.table(spark, rows), least=least, most=most).collect()}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, new, following = (plain_fingerprint(t, lexicon) for t in (text, edited, after))
        r = found[i]
        assert (r.fingerprint, r.edited_fingerprint) == (form(own), form(new))
        assert (r.near_edited, r.near_next) == pytest.approx((plain_likeness(own, new), plain_likeness(own, following)))
