"""Metrics, ordering helpers, sampling, text scores and column functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffscope.functions import review_text as R
from diffscope.functions import text as X
from diffscope.functions.stem import porter_stem
from diffscope.operators import evaluate as E
from diffscope.operators import labels as L
from diffscope.operators import ordered as O
from diffscope.operators import pooling as P
from diffscope.operators import sampling as S
from diffscope.operators import text_metrics as TM

Y = [0, 0, 1, 1, 1, 0]
PRED = [0, 1, 1, 1, 0, 0]
PROB = [0.1, 0.6, 0.6, 0.9, 0.4, 0.2]


def scored(spark, y, pred, prob):
    return spark.createDataFrame(list(zip(y, pred, prob)), "label int, prediction int, probability double")


def test_classification(spark):
    row = E.classification_metrics(scored(spark, Y, PRED, PROB)).first()
    assert row.accuracy == row.precision == row.recall == pytest.approx(2 / 3)
    assert row.f1 == pytest.approx(2 / 3) and row.roc_auc == pytest.approx(0.833333, abs=1e-6)
    again = E.classification_metrics(scored(spark, Y, [0] * 6, PROB)).first()
    assert again.asDict() == row.asDict()
    one_class = E.classification_metrics(scored(spark, [1] * 6, PRED, PROB)).first()
    assert one_class.roc_auc == 0.0 and one_class.precision == 1.0


def test_auc_is_exact_and_mirrored(spark):
    rows = [(m, (i * 7919) % 3 % 2, ((i * 104729) % 211) / 211.0) for m in ("a", "b") for i in range(600)]
    df = spark.createDataFrame(rows, "model string, label int, probability double")
    got = {r.model: r.roc_auc for r in E.roc_auc(df, ["model"], bound=7).collect()}
    pos = [p for m, y, p in rows if m == "a" and y == 1]
    neg = [p for m, y, p in rows if m == "a" and y == 0]
    expect = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert got["a"] == pytest.approx(expect)
    flipped = E.roc_auc(df.withColumn("probability", 1 - F.col("probability"))).first().roc_auc
    assert flipped == pytest.approx(1 - expect)


def test_row_numbers_and_running_totals(spark):
    df = spark.range(500).withColumn("d", F.md5(F.col("id").cast("string"))).withColumn("g", F.col("id") % 2)
    rows = sorted(O.row_numbers(df, "d", bound=40).collect(), key=lambda r: r.d)
    assert [r.row_idx for r in rows] == list(range(1, 501))
    grouped = spark.range(300).withColumn("g", F.col("id") % 3)
    total = O.running_total(grouped, ["g"], O.order_key(grouped, "id"), [], F.col("id"), "sum", bound=9)
    assert all(r["sum"] == sum(range(r.g, r.id + 1, 3)) for r in total.collect())


def test_running_totals_of_a_hot_value(spark):
    """A third of the rows have one value: they are split by the digest of their ties, and each gets a place of its own."""
    values = [0.25] * 60 + [float("nan"), float("-inf"), float("inf"), -0.0, 0.0, 1e-300, -1e300, None, None] + [
        i / 7 - 5 for i in range(100)]
    df = spark.createDataFrame([(i, v, "ab"[i % 2] if i % 5 else None) for i, v in enumerate(values)], "k long, v double, g string")
    for bound in (5, 10**6):
        found = O.running_total(df, ["g"], O.order_key(df, "v"), ["k"], F.lit(1), "n", bound=bound).collect()
        for g in ("a", "b", None):
            mine = sorted((r for r in found if r.g == g), key=lambda r: r.n)
            assert [r.n for r in mine] == list(range(1, len(mine) + 1))
            order = [-math.inf if r.v is None else math.inf if math.isnan(r.v) else r.v for r in mine]
            assert order == sorted(order)


def test_no_window_holds_more_rows_than_the_bound(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"))
    plan = O.running_total(df, [], O.order_key(df, "v"), ["id"], F.lit(1), "n", bound=100)
    assert sorted(r.n for r in plan.collect()) == list(range(1, 3001))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Window") > 3  # refined where a value is hot


@pytest.mark.parametrize("digits", [1, 3])
def test_split_sizes_and_order(spark, digits):
    df = spark.range(237).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    rows = S.stratified_split(df, ["id"], digits=digits, validation=0.1).collect()
    import hashlib
    for label in (0, 1):
        mine = sorted((r for r in rows if r.label == label), key=lambda r: hashlib.md5(f"{r.id}-42".encode()).hexdigest())
        n, t, v = len(mine), math.ceil(0.2 * len(mine)), math.ceil((0.2 + 0.1) * len(mine))
        assert [r.split for r in mine] == ["test"] * t + ["validation"] * (v - t) + ["train"] * (n - v)


def test_oversample_only_for_one_class(spark):
    one = spark.createDataFrame([(str(i), 1, [float(i), 2.0]) for i in range(60)], "k string, label int, features array<double>")
    grown = S.oversample_single_class(one, ["k"])
    assert {(r["label"], r["count"]) for r in grown.groupBy("label").count().collect()} == {(1, 60), (0, 15)}
    assert {r.features[1] for r in grown.collect()} == {2.0}
    assert sorted(map(str, grown.collect())) == sorted(map(str, S.oversample_single_class(one, ["k"]).collect()))
    assert grown.select("k").distinct().count() == 75
    whole = one.select(F.col("k").cast("int").alias("k"), "label", "features")
    numbers = S.oversample_single_class(whole, ["k"])
    assert numbers.select("k").distinct().count() == 75 and numbers.schema == whole.schema
    with pytest.raises(ValueError):
        S.oversample_single_class(one.select(F.col("k").cast("double").alias("k"), "label", "features"), ["k"])
    two = one.withColumn("label", (F.col("k") == "1").cast("int"))
    assert S.oversample_single_class(two, ["k"]) is two


def test_text_scores(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat is on the mat"), (2, "", "a b"), (3, "A b, c d!", "a b, c d!")],
                               "k int, generated string, reference string")
    rows = {r.k: r for r in TM.pair_scores(df, ["k"]).collect()}
    assert rows[1].bleu == pytest.approx(7.262e-78, rel=1e-3)
    assert (rows[1].rouge1, rows[1].rouge2, rows[1].rougeL) == pytest.approx((0.833333, 0.6, 0.833333), abs=1e-6)
    assert (rows[2].bleu, rows[2].rouge1, rows[2].rougeL) == (0, 0, 0)
    assert (rows[3].bleu, rows[3].rougeL) == pytest.approx((1, 1))
    assert TM.generation_metrics(df, ["k"]).first().rouge1 == pytest.approx((0.8333333 + 0 + 1) / 3)


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert TM._lcs_length(a, b) == table[-1][-1]


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
    ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("operator", "oper"),
    ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("adjustment", "adjust"), ("adoption", "adopt"),
    ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("dies", "die"), ("enjoy", "enjoy"),
])
def test_stems(word, stem):
    assert porter_stem(word) == stem


def test_pooling(spark):
    df = spark.createDataFrame([("x", i, [float(i), 1.0], float(i) * 500) for i in range(4)] + [("y", 0, [2.0, 3.0], -9e3)],
                               "bag string, i int, v array<double>, s double")
    sums = P.attention_weights(df, "bag", "s").groupBy("bag").agg(F.sum("attention_weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1) for r in sums)
    pooled = {r.bag: r.pooled for r in P.attention_pool(df, "bag", "v", "s").collect()}
    assert pooled == {"x": pytest.approx([3.0, 1.0]), "y": pytest.approx([2.0, 3.0])}
    import numpy as np
    w1, w2 = np.ones((3, 2)), np.ones(3)
    scores = df.select(P.attention_scores(F.col("v"), w1, w2).alias("a")).first().a
    assert scores == pytest.approx(3 * math.tanh(1.0))


def test_label_report(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "quality_score double")
    row = L.label_report(df, 1.5).first()
    assert (row.recommended_threshold, row["median"], row.positive_samples) == pytest.approx((2.8, 2.0, 2))
    assert row["std"] == pytest.approx(1.247219, abs=1e-6)
    assert L.label_report(df.where("false")).count() == 0


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_functions(spark):
    row = one(spark, trim=X.trim_py(F.lit("\x1c \t a \n")), parts=F.size(F.split(F.lit("a\nb\n"), "\n")),
              lines=X.splitlines(F.lit("a\r\nb\x0bc\u2028")), jac=X.jaccard_words(F.lit("a b c"), F.lit("B c d")),
              imports=X.regex_features(F.lit("fromage = 1"))["has_imports"], words=X.word_count(F.lit(" a  b\n")),
              magic=X.regex_features(F.lit("a 1 12 345 x99"))["magic_numbers"],
              accent=X.regex_features(F.lit("éif if"))["conditional_statements"],
              clean=X.clean_code(F.lit('a = 1  # x\n\n\n"""doc\n# in"""\nb')))
    assert row.trim == "a" and row.parts == 3 and row.lines == ["a", "b", "c"] and row.jac == 0.5
    assert (row.imports, row.words, row.magic, row.accent) == (1, 2, 2, 1)
    assert row.clean == 'a = 1  \n"""doc\n\nb'


def test_review_texts(spark):
    none = F.array().cast("array<string>")
    good = R.review_comments_array(none, F.lit(1), F.lit(1))
    bad = R.review_comments_array(F.array(F.lit("todo_markers_detected"), F.lit("x")), F.lit(11), F.lit(6),
                                  [R.model_comment("svm", F.lit(0.0), F.lit(0.2))], F.lit(0.5))
    row = one(spark, good=good, bad=bad,
              mod=R.change_line(F.lit("a b\nc"), F.lit("d")), words=R.change_line(F.lit("a b\nc"), F.lit("d"), True),
              empty=R.combined_feedback(F.lit(""), F.lit(""), none))
    assert row.good == [R.ALL_GOOD]
    assert row.bad == ["⚠️ Svm model flags this code as potentially problematic (confidence: 0.80)",
                       "🤖 CodeBERT analysis suggests code quality concerns (score: 0.50)",
                       R.ISSUE_MESSAGES["todo_markers"], R.COMPLEX, R.MANY_FUNCTIONS]
    assert (row["mod"], row.words, row.empty) == ("Modified 2 -> 1 lines", "Modified 3 -> 1 lines", [R.NOTHING_FOUND])


def test_parse_review(spark):
    texts = ['{"assessment": "ok", "issues": ["a"]}', "```json\n{\"security\": \"s\"}\n```", "free text", "[1]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", R.parse_review(F.col("t")).alias("r")).orderBy("i").collect()
    assert rows[0].r.assessment == "ok" and rows[0].r["issues"] == '["a"]' and rows[1].r.security == "s"
    assert rows[2].r.analysis == "free text" and rows[3].r.analysis == "[1]" and rows[4].r is None


@pytest.mark.parametrize("leaf", [4096, 30])
def test_draws_are_uniform_with_replacement(spark, monkeypatch, leaf):
    monkeypatch.setattr(S, "LEAF_ROWS", leaf)
    monkeypatch.setattr(S, "DIGITS", 1)
    df = spark.range(400).withColumn("_digest", F.md5(F.col("id").cast("string")))
    found = S.drawn_with_replacement(df, "_digest", 400, 4000).collect()
    assert len(found) == 4000 and sorted({r["_copy"] for r in found}) == sorted(r["_copy"] for r in found)
    counts = [0] * 400
    for r in found:
        counts[r.id] += 1
    spread = sum((c - 10) ** 2 for c in counts) / 400
    assert 7 < spread < 13 and max(counts) < 30 and min(counts) < 10  # variance of a multinomial: 10


def test_splits_of_rows_without_a_label(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") % 2 == 0, F.lit(1)))
    counts = {(r["label"], r["split"]): r["count"] for r in S.stratified_split(df, ["id"]).groupBy("label", "split").count().collect()}
    assert counts == {(None, "test"): 10, (None, "train"): 40, (1, "test"): 10, (1, "train"): 40}


@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_shared_grams(pairs):
    from collections import Counter

    import pyarrow as pa

    kind = pa.list_(pa.string())
    found = TM._overlaps(pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind), 3)
    for n in (1, 2, 3):
        grams = [[Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in p] for p in pairs]
        assert found[n - 1].tolist() == [sum((a & b).values()) for a, b in grams]


def test_text_scores_stay_in_the_row(spark):
    df = spark.createDataFrame([(1, "a b", "a c"), (1, None, "x"), (1, "a b", "a c")], "k int, generated string, reference string")
    scores = TM.pair_scores(df, ["k"], stem=False, scores=("bleu", "rouge1", "rouge2"))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "_lcs_batch" not in plan and scores.count() == 3


def test_percentiles_by_group(spark):
    import numpy as np

    rows = [(g, float(v)) for g, values in (("a", [1, 5, 5, 5, 9, 2]), (None, [3.5]), ("b", range(40))) for v in values]
    df = spark.createDataFrame(rows, "lang string, quality_score double")
    for r in L.label_report(df, 1.5, ["lang"]).collect():
        mine = [v for g, v in rows if g == r.lang]
        assert (r["median"], r.recommended_threshold, r["std"]) == pytest.approx(
            (np.quantile(mine, 0.5), np.quantile(mine, 0.7), np.std(mine)))
