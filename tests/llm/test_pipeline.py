"""Pipeline stages against brute force, and the registered queries against their SQL."""

import glob
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from diffscope.llm import toxicity
from diffscope.llm.queries import QUERIES, SQL
from diffscope.llm.store import written
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = cases.documents()
    long = next(t for _, t in rows if t and len(t) > 10_000).split()
    spark.createDataFrame([(1, " ".join(long[40:55])), (2, None)], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows if i is not None], "doc_id long, toxic int").write.parquet(
        f"{path}/labels.parquet")
    secret = [(9001, "my password = hunter22 and token: zzzzzz", None), (9001, "my password = hunter22 and token: zzzzzz", None)]
    table = cases.table(spark, [*rows, *[(i, t) for i, t, _ in secret]])
    table.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "n-gram join", "decontamination", "secrets", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = toxicity.scores(docs, model, keep=("text",)).collect()
    clean = written(stages["toxicity"](spark, docs, folder), "t1")
    assert clean.columns == docs.columns
    assert plain(clean.select("doc_id", "text").collect()) == plain((r.doc_id, r.keep_text) for r in scores if r.score < 0.3)

    rows = [(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()]
    unique = written(stages["n-gram join"](spark, clean, folder), "t2")
    assert unique.columns == docs.columns
    expected = {(i, t) for (i, t), (_, _, _, component) in zip(rows, cases.linked(rows)) if i == component}
    assert plain(unique.select("doc_id", "text").collect()) == plain(expected)

    rows = [(r.doc_id, r.text) for r in unique.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    free = written(stages["decontamination"](spark, unique, folder), "t3")
    assert free.columns == docs.columns
    hit = [r[-1] for r in cases.contaminated(rows, items)]
    assert plain(free.select("doc_id", "text").collect()) == plain(r for r, h in zip(rows, hit) if not h)

    safe = written(stages["secrets"](spark, free, folder), "t4")
    assert safe.columns == docs.columns and safe.count() == free.count()
    before = {(r.doc_id, r.n_chars): r for r in free.collect()}
    for r in safe.collect():
        if r.doc_id == 9001:
            assert r.text == "my [secret] and [secret]" and r.n_chars == len(r.text)
        else:
            assert r == before[r.doc_id, r.n_chars]

    packed = stages["packing"](spark, safe, folder)
    total = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    words = {}
    for r in safe.select("doc_id", "text").collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(cases.split(r.text))
    assert total == words


def test_one_document_of_each_group_stays(spark, folder):
    words = cases.prose(random.Random(7), 120).split()
    near = [" ".join([*words[:k], "changed", *words[k + 1:]]) for k in (10, 20, 30)]
    other = cases.prose(random.Random(8), 120).split()
    taken = [" ".join([*other[:k], "changed", *other[k + 1:]]) for k in (10, 20, 30)]
    alone = [cases.prose(random.Random(k), 60) for k in (9, 10)]
    rows = [*[(None, t) for t in near], *[(5, t) for t in taken], (6, taken[0]), (None, taken[1]), (None, alone[0]),
            (5, alone[1]), (None, ""), (None, None), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()]
    stay = [r for r in found if r[1] in near], [r for r in found if r[1] in taken], [r for r in found if r[1] not in near + taken]
    assert len(stay[0]) == len(stay[1]) == 1 and stay[0][0][0] is None and stay[1][0][0] == 5
    assert plain(stay[2]) == plain([(None, alone[0]), (5, alone[1]), (None, ""), (None, None), (7, ""), (8, None)])


def test_run_is_the_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "t")
    expected = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert plain(corpus_pipeline.run(spark, folder).collect()) == plain(expected.collect())


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries() and set(SQL) <= set(QUERIES) and "pipeline" not in oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, tables, name):
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = tables.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert plain(ours.select(columns).collect()) == plain(theirs)
