"""Queries over texts with other than ASCII characters, against brute force in Python."""

import re

from diffscope.plans.queries import REGISTRY

TEXTS = [
    "¿Qué? ¡si no!", "if—else – for…while", "éif if ifé", "def año(): # TODO", "naïve «class» 12 345 x99 ٣٤",
    "\n from x import y\nprint (1)", "try：except。finally", "日本語 テスト, ok", "", "plain words only", "print\u00a0(2) FIXME xxx",
]


def table(spark, folder):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_token_count_of_the_text_itself(spark, tmp_path):
    rows = REGISTRY["token_count"](spark, table(spark, tmp_path)).collect()
    assert {r.doc_id: r.tokens for r in rows} == {i: len(re.findall(r"\w+|[^\w\s]", t)) for i, t in enumerate(TEXTS)}


def test_regex_features_of_the_text_itself(spark, tmp_path):
    counts = {"conditional_statements": r"\b(?:if|elif)\b", "loop_statements": r"\b(?:for|while)\b",
              "exception_handling": r"\b(?:try|except|finally)\b", "debug_prints": r"print\s*\(",
              "todo_comments": "(?i)TODO|FIXME|XXX", "magic_numbers": r"\b\d{2,}\b"}
    flags = {"has_functions": r"\bdef\b", "has_classes": r"\bclass\b", "has_imports": r"(?m)^\s*(?:import|from)"}
    rows = REGISTRY["regex_features"](spark, table(spark, tmp_path)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id]
        assert {n: r[n] for n in counts} == {n: len(re.findall(p, text)) for n, p in counts.items()}
        assert {n: r[n] for n in flags} == {n: int(bool(re.search(p, text))) for n, p in flags.items()}
