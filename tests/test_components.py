"""Connected components against a plain union-find."""

import random

import pytest

from diffscope.operators.components import Forest, connected
from diffscope.session import checkpointed


def expected(edges):
    forest = Forest()
    for u, v in edges:
        forest.join(u, v)
    groups = {}
    for x in forest.parent:
        groups.setdefault(forest.find(x), []).append(x)
    return {x: min((m for m in members if m is not None), default=None) for members in groups.values() for x in members}


def cases():
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(3000)]
    rng.shuffle(chain)
    star = [(0, i) for i in range(1, 2000)]
    some = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(2500)]
    odd = [(1, 1), (2, 3), (2, 3), (3, 2), (None, 7), (None, None), (7, 8)]
    return {"chain": chain, "star": star, "some": some, "odd": odd, "none": []}


@pytest.mark.parametrize("name", cases())
@pytest.mark.parametrize("limit", [300, 100_000])
def test_components(spark, name, limit):
    edges = cases()[name]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    found = [tuple(r) for r in connected(df, checkpointed, limit=limit).collect()]
    assert len(found) == len(set(found)) and dict(found) == expected(edges)


def test_bytes_as_nodes(spark):
    edges = [(bytes([a]), bytes([b])) for a, b in ((3, 2), (2, 9), (5, 6))]
    found = connected(spark.createDataFrame(edges, "u binary, v binary"), checkpointed).collect()
    assert {bytes(r.node)[0]: bytes(r.root)[0] for r in found} == {2: 2, 3: 2, 9: 2, 5: 5, 6: 5}
