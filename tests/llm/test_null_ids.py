"""A third of all rows without an id, and many with one id."""

import random

import pytest

from diffscope.llm import queries, substring_dedup
from diffscope.llm.store import shared_folder
from tests.llm import cases


def rows(seed=6):
    """Passages are shared by rows with ids, or by null rows with one with an id, so that their order is defined."""
    rng = random.Random(seed)
    shared = [cases.prose(rng, 30) for _ in range(4)]
    out = [(i, f"{cases.prose(rng, 25)} {shared[i % 2]} {cases.prose(rng, 10)}") for i in range(40)]
    out += [(None, f"{cases.prose(rng, rng.randint(3, 30))} {shared[0]}") for _ in range(30)]
    out += [(None, "the same words again and again " * 8)] * 20 + [(7, cases.prose(rng, 40)) for _ in range(15)]
    out += [(None, "  ".join(out[3][1].split())), (7, out[5][1]), (None, None), (None, "")]
    rng.shuffle(out)
    return out


def test_repeats_among_null_and_repeated_ids(spark):
    queries.configure(spark)
    data = rows()
    found = substring_dedup.remove_repeats(cases.table(spark, data)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, cases.unrepeated(data)))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, name, default=None):
            return self.master if name == "spark.master" else default

        def set(self, name, value):
            self.folder = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(Session(master), "x")
    assert shared_folder(Session("local[4]"), "x").startswith("/")
