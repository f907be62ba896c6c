"""Log dumps by byte ranges."""

import random

import pytest
from pyspark.sql import functions as F

from diffscope.sources import log_dump as LD
from diffscope.sources.patches import has_patch, read_log

HASHES = [f"{i:040x}" for i in range(1, 41)]


def dump():
    rng = random.Random(7)
    out, rows = "", []
    for i, h in enumerate(HASHES):
        parents = [] if i == 39 else [HASHES[i + 1]] if i % 7 else [HASHES[i + 1], HASHES[0]]
        date = f"2024-03-{28 - i // 2:02d}T1{i % 2}:00:00{'+02:00' if i % 3 else 'Z'}"
        body = f"subject {i}\n\ncommit {h} in the text" if i % 4 else "one line"
        lines = "\n".join(f"+commit {rng.choice(HASHES)}" for _ in range(rng.choice([1, 3, 200])))
        patch = f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -0,0 +1,1 @@\n{lines}" if len(parents) == 1 else ""
        text = f"commit {' '.join([h, *parents])}\n" + ("Merge: a b\n" if len(parents) > 1 else "") + (
            f"Author: Añn B <a@x>\nDate:   {date}\n\n" + "\n".join("    " + x for x in body.split("\n")) + "\n")
        out += text + (f"\n{patch}\n" if patch else "") + "\n"
        rows.append((h, parents[0] if parents else None, len(parents) > 1, "Añn B", date, body, patch))
    return out, rows


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_ranges_give_every_commit_once(spark, tmp_path, monkeypatch, split):
    text, rows = dump()
    (tmp_path / "log.txt").write_text(text)
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "_hidden").write_text(text)
    found = LD.read_dump(spark, str(tmp_path), split_bytes=split).collect()
    got = sorted((r.commit_hash, r.parent_hash, r.is_merge, r.author, r.committed_date, r.message, r.patch) for r in found)
    assert got == sorted(rows, key=lambda r: r[0])
    native = read_log(spark, str(tmp_path / "log.txt")).collect()
    times = {r.commit_hash: (r.committed_at, r.message) for r in native}
    assert times == {r.commit_hash: (r.committed_at, r.message) for r in found}


@pytest.mark.parametrize("size", [50, 300, 5000])
def test_records_across_reads(monkeypatch, size):
    text, rows = dump()
    raw = text.encode()
    monkeypatch.setattr(LD, "READ_BYTES", size)
    for split in (61, 700, len(raw)):
        found = [LD.parse_record(x, False)["commit_hash"] for low in range(0, len(raw), split)
                 for x in LD.records(lambda at, n: raw[at:at + n], low, min(low + split, len(raw)))]
        assert found == HASHES


def test_filters_and_patches_are_pushed_down(spark, tmp_path):
    text, rows = dump()
    (tmp_path / "log.txt").write_text(text)
    found = LD.read_dump(spark, str(tmp_path / "log.txt"), patch=False)
    assert "patch" not in found.columns
    late = found.where(F.col("committed_at") >= F.lit("2024-03-20T00:00:00Z").cast("timestamp"))
    kept = [r[0] for r in rows if r[4] >= "2024-03-20"]
    assert sorted(r.commit_hash for r in late.collect()) == kept
    reader = LD.LogReader({"path": "x"})
    from datetime import datetime, timezone

    at = datetime(2024, 3, 20, tzinfo=timezone.utc)
    assert len(list(reader.pushFilters([LD.GreaterThan(("committed_at",), at), LD.EqualTo(("author",), "x")]))) == 2
    assert reader.least == at - LD.MARGIN and reader.most is None


def test_patches_of_a_dump(spark, tmp_path):
    (tmp_path / "log.txt").write_text(dump()[0])
    found = LD.read_dump(spark, str(tmp_path))
    assert found.where(has_patch()).count() == sum(bool(r[-1]) for r in dump()[1])
