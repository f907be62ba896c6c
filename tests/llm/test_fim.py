"""Fill-in-the-middle against a plain version."""

import hashlib
import random
import re

import pytest

from diffscope.llm import fim, queries
from tests.llm import cases

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    odd = ["<P>", "a <S> b", "x<M>", "<P", "<", " lead and trail \n", "\n\n", "é" * 9 + " ü\tß", "w" * 5000 + " a b", "\x00 a\x1f b\x85c"]
    own = [(1000 + i, f"{rng.choice(odd)}{'' if i % 3 else ' '}{cases.prose(rng, rng.randint(0, 40))}") for i in range(120)]
    return cases.documents() + own + [(7, t) for t in odd] + [(5000, "the same row " * 40)] * 60


@pytest.mark.parametrize("piece_bytes", [fim.PIECE_BYTES, 50])
def test_outputs_and_digests(spark, rows, piece_bytes):
    queries.configure(spark)
    docs = cases.table(spark, rows, 6)
    found = fim.pieces(docs, piece_bytes=piece_bytes)
    whole = sorted(map(repr, (tuple(r) for r in fim.texts(found).collect())))
    expected = [plain(*r) for r in rows]
    assert whole == sorted(map(repr, expected))
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    got = sorted(map(repr, (tuple(r) for r in fim.digests(found).collect())))
    assert got == sorted(repr((*e[:5], sha(e[5]), sha(t))) for e, (_, t) in zip(expected, rows))


def test_outputs_alone_give_the_texts(spark, rows):
    found = fim.texts(fim.pieces(cases.table(spark, rows)))
    back = found.select("doc_id", fim.restored(found["output"], found["form"]).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)


def test_pieces_are_whole_units():
    text = b"aa bb cc " + b"d" * 30 + b" e"
    ends = fim.unit_ends(fim.np.frombuffer(text, dtype=fim.np.uint8), fim.np.array([0, len(text)]))
    assert list(fim._split(text, ends, 0, len(text), 7)) == [b"aa bb", b" cc", b" " + b"d" * 30, b" e"]


def test_one_exchange_for_both_sorts(spark, rows):
    plan = fim.digests(fim.pieces(cases.table(spark, rows)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Sort [key") == 2


def test_empty(spark):
    none = cases.table(spark, []).limit(0)
    assert fim.digests(fim.pieces(none)).count() == 0 and fim.texts(fim.pieces(none)).count() == 0
