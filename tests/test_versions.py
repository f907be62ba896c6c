"""Patches between versions, previous versions and versions as of a commit."""

import random

import pytest
from pyspark.sql import functions as F

from diffscope.operators import versions as VS
from diffscope.operators.carried import carried
from diffscope.operators.diff import patch_hunks
from diffscope.sources.patches import files_as_of, previous_versions


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(60))
@pytest.mark.parametrize("bits", [VS.TABLE_BITS, 20])
def test_scripts_are_shortest(seed, bits):
    rng = random.Random(seed)
    letters = rng.choice([2, 4, 30])
    a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
    if seed % 3 == 0:
        b = [x for x in a if rng.random() < 0.8]
    pairs = VS.matches(a, b, bits)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == common(a, b)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_versions_of_few_different_lines():
    rng = random.Random(1)
    a = [rng.randrange(50) for _ in range(9000)]
    b = a[:]
    rng.shuffle(b)
    pairs = VS.matches(a, b)
    assert len(pairs) > 500 and VS.matches(a, a) == [(i, i) for i in range(9000)]


TEXTS = [None, "", "a", "a\n", "a\nb", "a\nb\n", "\n", "\n\n", "a\r\nb\r\n", "x\ny\nz", "@@ -1 +1 @@\n--- a\n+++ b\n-q\n",
         "\\ No newline at end of file\n", "diff --git a/x b/x\n", "é\n\u2028\nü", "one\n" * 30, "one\n" * 12 + "two\n" + "one\n" * 17]


def pairs():
    rng = random.Random(6)
    rows = [(f"f{i}.py", a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    for i in range(120):
        a = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))]
        b = [x for x in a if rng.random() < 0.9]
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), "new")
        rows.append((f'd "{i}"/ü.py' if i % 9 == 0 else f"d/{i}.py", "\n".join(a), "\n".join(b) + "\n" * (i % 2)))
    return rows


def test_patches_lead_from_one_version_to_the_other(spark):
    rows = pairs()
    df = spark.createDataFrame(rows, "path string, old string, new string").repartition(3)
    made = df.withColumn("patch", VS.version_patch(F.col("path"), F.col("old"), F.col("new"))).withColumn(
        "kind", VS.change_type(F.col("old"), F.col("new"))).withColumn(
        "forward", VS.patched(F.col("old"), F.col("patch"))).withColumn(
        "backward", VS.patched(F.col("new"), F.col("patch"), reverse=True))
    for r in made.collect():
        assert (r.forward, r.backward) == (r.new or "", r.old or ""), r.path
        assert (r.patch == "") == (r.old == r.new) == (r.kind is None)


def test_the_parser_reads_the_patches(spark):
    rows = [(str(n), *r) for n, r in enumerate(pairs())]
    df = spark.createDataFrame(rows, "commit_hash string, path string, old string, new string")
    made = df.withColumn("patch", VS.version_patch(F.col("path"), F.col("old"), F.col("new")))
    found = {}
    for r in patch_hunks(made.select("commit_hash", "patch"), extensions=None, placeholder=False).collect():
        at = found.setdefault(r.commit_hash, [r.file_path, r.change_type, [], []])
        at[2] += r.added_lines
        at[3] += r.removed_lines
    for key, path, old, new in rows:
        a, b = (VS.split_lines(x or "") for x in (old, new))
        if a == b:
            assert key not in found
            continue
        numbers = {}
        kept = VS.matches(*([numbers.setdefault(x, len(numbers)) for x in side] for side in (a, b)))
        gone, came = {i for i, _ in kept}, {j for _, j in kept}
        kind = "A" if old is None else "D" if new is None else "M"
        assert found[key] == [path, kind, [x.removesuffix("\n") for j, x in enumerate(b) if j not in came],
                              [x.removesuffix("\n") for i, x in enumerate(a) if i not in gone]]


def test_a_patch_that_does_not_fit():
    with pytest.raises(ValueError):
        VS.applied("x\ny\n", VS.unified("f", "a\nb\n", "a\nc\n"))


def history():
    rng = random.Random(9)
    rows = [("hot", i, f"v{i}" if rng.random() < 0.02 else None) for i in range(900)]
    rows += [(rng.choice(["a", "b", "c", None]), rng.randrange(200), rng.choice([None, "w", "x", "y"])) for _ in range(700)]
    rows += [("quiet", i, None) for i in range(300)] + [("d", None, None), ("d", None, "lost"), ("d", 4, "kept")]
    return rows


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_files_as_of(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = history()
        df = spark.createDataFrame(rows, "file_path string, seq long, content string").repartition(5)
        snapshots = df.where("content IS NOT NULL").groupBy("file_path", "seq").agg(F.max("content").alias("content"))
        found = files_as_of(snapshots, df.where("content IS NULL").select("file_path", "seq")).collect()
        best = {}
        for p, s, c in rows:
            if c is not None and s is not None:
                best.setdefault(p, {})[s] = max(c, best.get(p, {}).get(s, c))
        expected = []
        for p, s, c in rows:
            if c is None:
                later = [v for v in best.get(p, {}) if s is not None and v >= s]
                expected.append((p, s, best[p][min(later)] if later else ""))
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


@pytest.mark.parametrize("partitions", [1, 40])
def test_previous_versions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [("hot" if i % 3 else f"p{i % 7}", i, f"text {i}" if i % 5 else None) for i in range(500)] + [(None, 1, "n"), (None, 2, "m")]
        df = spark.createDataFrame(rows, "file_path string, seq long, content string").repartition(4)
        found = {(r.file_path, r.seq): (r.content, r.old_content) for r in previous_versions(df).collect()}
        last, expected = {}, {}
        for p, s, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            expected[p, s] = (c, last.get(p))
            last[p] = c
        assert found == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_contents_are_exchanged_once(spark):
    df = spark.createDataFrame(history(), "file_path string, seq long, content string")
    plan = carried(df.withColumn("m", F.lit(True)), ["file_path"], [F.col("file_path"), F.col("seq")], "m", ["content"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in text and text.count("Relation") == 4  # all four read what the one pass wrote


def test_nothing(spark):
    none = spark.createDataFrame([], "file_path string, seq long, content string")
    assert files_as_of(none, none.drop("content")).count() == 0 and previous_versions(none).count() == 0
