"""Diff parsing, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from diffscope.operators import diff as D
from diffscope.sources import patches as SP
from diffscope.sources import tables as ST

TWO_FILES = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1,2 +1,2 @@ def f
-old
+new
 keep
diff --git a/my dir/y.py b/my dir/y.py
new file mode 100644
--- /dev/null
+++ b/my dir/y.py
@@ -0,0 +1 @@
+only
\\ No newline at end of file"""
BINARY = "diff --git a/p.css b/p.css\nnew file mode 100644\nBinary files /dev/null and b/p.css differ"
SIGNS = "diff --git a/q.py b/q.py\n--- a/q.py\n+++ b/q.py\n@@ -9 +9,2 @@ def f\n--- sql comment\n+++ counter\n+x\n-- \n2.40"


def patches(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "commit_hash string, patch string")


def test_hunks_of_every_file_are_kept(spark):
    rows = D.patch_hunks(patches(spark, c=TWO_FILES)).orderBy("file_idx").collect()
    assert [(r.file_path, r.change_type, r.added_lines, r.removed_lines, r.context_lines) for r in rows] == [
        ("x.py", "M", ["new"], ["old"], ["keep"]), ("my dir/y.py", "A", ["only"], [], [])]
    assert [(r.new_start, r.new_count, r.line_end) for r in rows] == [(1, 2, 2), (1, 1, 1)]
    assert {(r.files_changed, r.total_hunks, r.commit_size) for r in rows} == {(2, 2, 2)}
    assert rows[1].raw_lines == ["+only", "\\ No newline at end of file"]


def test_two_step_equals_one_step(spark):
    p = patches(spark, c=TWO_FILES, d=BINARY, e="")
    one = D.patch_hunks(p)
    two = D.with_commit_context(D.parse_hunks(D.parse_files(p)))
    columns = sorted(set(one.columns) & set(two.columns))
    assert {"files_changed", "raw_lines"} <= set(columns)
    assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, two.select(columns).collect()))


def test_placeholder_and_extension_filter(spark):
    p = patches(spark, d=BINARY, t=TWO_FILES.replace("y.py", "y.txt"))
    rows = D.patch_hunks(p).orderBy("commit_hash").collect()
    assert [(r.hunk_type, r.file_path) for r in rows] == [("new_file", "p.css"), ("hunk", "x.py")]
    assert rows[0].added_lines == [D.PLACEHOLDER_LINE]
    assert D.parse_files(p, drop_binary=True).count() == 1


def test_double_signs(spark):
    plain = D.patch_hunks(patches(spark, c=SIGNS), compat=True).first()
    strict = D.patch_hunks(patches(spark, c=SIGNS)).first()
    assert (plain.added_lines, plain.removed_lines) == (["x"], ["- "])
    assert (strict.added_lines, strict.removed_lines) == (["++ counter", "x"], ["-- sql comment"])
    assert (plain.old_start, plain.old_count, plain.line_end) == (9, 1, 10)


def test_log_source(spark, tmp_path):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    (tmp_path / "log.txt").write_text(
        f"commit {c} {b}\nAuthor: Ann <a@x>\nDate:   2024-05-03T10:00:00+02:00\n\n    third\n    \n    commit in text\n\n"
        + TWO_FILES + f"\n\ncommit {b} {a} {a}\nMerge: 1 2\nAuthor: Bo <b@x>\nDate:   2024-05-02T10:00:00+00:00\n\n    merge\n\n"
        f"commit {a}\nAuthor: Ann <a@x>\nDate:   2024-05-01T10:00:00+00:00\n\n    first\n")
    commits, found = SP.read_patches(spark, str(tmp_path / "log.txt"))
    rows = {r.commit_hash: r for r in commits.collect()}
    assert set(rows) == {a, b, c}
    assert rows[c].message == "third\n\ncommit in text" and rows[c].author == "Ann" and rows[c].parent_hash == b
    assert rows[b].is_merge and rows[a].parent_hash is None
    assert [r.commit_hash for r in found.collect()] == [c]
    assert D.patch_hunks(found).count() == 2
    recent = SP.recent_commits(commits, D.parse_files(found), "x.py").collect()
    assert [(r.short_hash, r.date) for r in recent] == [("c" * 8, "2024-05-03T10:00:00+02:00")]
    assert SP.recent_commits(commits.drop("committed_date")).first().date == "2024-05-03T08:00:00Z"
    _, kept = SP.read_patches(spark, str(tmp_path / "log.txt"), metadata=True)
    assert {(r.message, r.author) for r in D.patch_hunks(kept).collect()} == {("third\n\ncommit in text", "Ann")}
    assert {r.commit_hash: r.seq for r in SP.with_sequence(commits).collect()} == {c: 0, b: 1, a: 2}


def test_files_as_of_against_brute_force(spark):
    snaps = [(p, s, f"{p}{s}") for p in "ab" for s in range(0, 400, 7)]
    asks = [(p, s) for p in "abz" for s in range(0, 420, 5)]
    found = SP.files_as_of(spark.createDataFrame(snaps, "file_path string, seq int, content string"),
                           spark.createDataFrame(asks, "file_path string, seq int")).collect()
    expect = {(p, s): next((c for q, t, c in sorted(snaps, key=lambda x: x[1]) if q == p and t >= s), "") for p, s in asks}
    assert {(r.file_path, r.seq): r.content for r in found} == expect


def test_full_files(spark, tmp_path):
    (tmp_path / "m.py").write_text("a = 1\nb = 2\n")
    row = D.full_file_hunks(SP.read_files(spark, str(tmp_path))).first()
    assert row.added_lines == ["a = 1", "b = 2"] and row.line_end == 2 and row.file_path.endswith("m.py")


def test_review_comment_tables(spark, tmp_path):
    assert ST.read_review_comments(spark).count() == 3
    (tmp_path / "c.csv").write_text('commit_hash,file_path,line_number,comment,quality_score\nh,f.py,3,"a, ""b""",0.5\n')
    assert ST.read_review_comments(spark, str(tmp_path / "c.csv")).first().comment == 'a, "b"'
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("f", 1, "x", None)], "file_path string, line_number int, comment string, commit_hash string")
    ST.append_comments(rows, out)
    ST.append_comments(rows, out)
    assert [r.commit_hash for r in spark.read.parquet(out).collect()] == ["current", "current"]


def test_padding(spark):
    real = D.patch_hunks(patches(spark, c=TWO_FILES))
    padded = ST.padded_hunks(real, 1)
    assert padded.select("commit_hash").distinct().count() == 100
    assert ST.padded_hunks(real, 50) is real
    first = padded.where("commit_hash = 'synthetic_1'").first()
    assert first.added_lines[0] == "def process_user_1_data(user_1_input: dict) -> dict:"
    assert padded.where(F.col("message").contains("low")).count() == 66


def test_commit_stats(spark):
    hunks = D.patch_hunks(patches(spark, c=TWO_FILES))
    assert D.commit_stats(hunks).first().asDict() == {
        "commit_hash": "c", "total_insertions": 2, "total_deletions": 1, "files_changed": 2}


PROBE = {
    "c1": "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n--- drop comment\n-- x\n++++i\n+y",
    "c2": "diff --git a/n.txt b/n.txt\n--- a/n.txt\n+++ b/n.txt\n@@ -0,0 +1 @@\n+one\n"
          "diff --git a/p.png b/p.png\nnew file mode 100644\nBinary files /dev/null and b/p.png differ\n"
          "diff --git a/o.md b/m.md\nsimilarity index 100%\nrename from o.md\nrename to m.md",
    "c3": "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-p\n+q\n"
          'diff --git "a/\\303\\251 \\"t\\".py" "b/\\303\\251 \\"t\\".py"\n--- "a/x"\n+++ "b/x"\n@@ -1 +1 @@\n-q\n+r',
    "c4": "",
}


def test_stats_keep_every_line_file_and_commit(spark):
    p = patches(spark, **PROBE)
    found = {r.commit_hash: tuple(r)[1:] for r in D.patch_commit_stats(p).collect()}
    assert found == {"c1": (2, 2, 1), "c2": (1, 0, 3), "c3": (2, 2, 2), "c4": (0, 0, 0)}
    files = {(r.commit_hash, r.file_path): (r.change_type, r.insertions, r.deletions) for r in D.patch_file_stats(p).collect()}
    assert files[("c2", "p.png")] == ("A", 0, 0) and files[("c2", "m.md")] == ("R", 0, 0)
    assert files[("c2", "n.txt")] == ("M", 1, 0)


def test_quoted_paths_are_files_of_their_own(spark):
    rows = D.patch_hunks(patches(spark, c3=PROBE["c3"])).collect()
    assert [(r.file_path, r.hunk_idx, r.added_lines, r.removed_lines) for r in rows] == [
        ("a.py", 0, ["q"], ["p"]), ('é "t".py', 0, ["r"], ["q"])]


def test_snapshots_are_added_or_deleted(spark):
    from pyspark.errors import PySparkException

    one = spark.range(1).select(D.snapshot_patch(F.lit("a.py"), F.lit("M"), F.lit("x")).alias("patch"))
    with pytest.raises(PySparkException):
        one.collect()
