"""Registered queries against their SQL statements."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, tables, name):
    ours = queries()[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = tables.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    key = repr
    left = sorted((tuple(r) for r in normal_rows(ours.select(columns).collect())), key=key)
    right = sorted((tuple(r) for r in normal_rows(theirs)), key=key)
    assert left == right


def normal_rows(rows):
    for r in rows:
        yield [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns == ["commit_hash", "file_path", "line_number", "comment_idx", "comment"]
