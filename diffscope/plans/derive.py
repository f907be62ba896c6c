"""Inputs for the registered queries, derived row by row from the given tables (whole tables, whole texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffscope.session import READ_PARTITIONS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; with the setting READ_PARTITIONS, dealt to that many partitions (for files of one row group)."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    wanted = spark.conf.get(READ_PARTITIONS, None)
    return found.repartition(int(wanted)) if wanted else found


def _s(value: Column) -> Column:
    return value.cast("string")


# File extensions of the derived patches; txt is outside the default filter.
EXTENSIONS = ("py", "js", "md", "json", "txt")


def document_hash(doc_id: Column) -> Column:
    return F.md5(_s(doc_id))


def _signed(lines: Column, kind: Column) -> Column:
    def sign(i):
        return (F.when(kind == 0, "+").when(kind == 1, "-")
                .when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "))

    return F.transform(lines, lambda x, i: F.concat(sign(i), x))


def _hunk_text(lines: Column, old_start: Column, new_start: Column) -> Column:
    head = F.concat(F.lit("@@ -"), _s(old_start), F.lit(","), _s(_old_lines(lines)), F.lit(" +"), _s(new_start),
                    F.lit(","), _s(_new_lines(lines)), F.lit(" @@"))
    return F.concat_ws("\n", head, F.array_join(lines, "\n"))


def _old_lines(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: ~x.startswith("+")))


def _new_lines(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: ~x.startswith("-")))


def document_patches(documents: DataFrame) -> DataFrame:
    """One commit per document: commit columns and `patch`.

    doc_id % 5 = 0 adds the document's lines as a new file, 1 deletes them, the rest mixes added, removed and context
    lines. More than six lines make two hunks. Every fourth commit adds a note file, every seventh a binary file.
    """
    doc = F.col("doc_id")
    kind = doc % 5
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), ((F.floor(doc / 5) % 5) + 1).cast("int"))
    lines = F.split("text", "\n")
    base = documents.select(
        "doc_id", "source", "text",
        F.concat(F.lit("src/"), F.col("source"), F.lit("/doc_"), _s(doc), F.lit("."), ext).alias("path"),
        kind.alias("kind"), lines.alias("lines"), _signed(lines, kind).alias("signed"))
    n = F.size("lines")
    cut = F.when(n > 6, F.floor(n / 2)).otherwise(n).cast("int")
    first = F.slice("signed", F.lit(1), cut)
    second = F.slice("signed", cut + 1, F.greatest(n - cut, F.lit(0)))
    deleted, added = F.col("kind") == 1, F.col("kind") == 0
    head = F.concat(
        F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"), F.lit("\n"),
        F.when(added, "new file mode 100644\n").when(deleted, "deleted file mode 100644\n").otherwise(""),
        F.lit("--- "), F.when(added, "/dev/null").otherwise(F.concat(F.lit("a/"), F.col("path"))),
        F.lit("\n+++ "), F.when(deleted, "/dev/null").otherwise(F.concat(F.lit("b/"), F.col("path"))))
    body = F.concat(
        _hunk_text(first, F.lit(1), F.lit(1)),
        F.when(n > cut, F.concat(F.lit("\n"), _hunk_text(second, _old_lines(first) + 1, _new_lines(first) + 1)))
        .otherwise(""))
    note_path = F.concat(F.lit("docs/note_"), _s(doc), F.lit(".md"))
    note = F.concat(
        F.lit("diff --git a/"), note_path, F.lit(" b/"), note_path,
        F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), note_path,
        F.lit("\n@@ -0,0 +1,"), _s(n), F.lit(" @@\n"),
        F.array_join(F.transform("lines", lambda x: F.concat(F.lit("+"), x)), "\n"))
    image_path = F.concat(F.lit("img/pic_"), _s(doc), F.lit(".css"))
    image = F.concat(
        F.lit("diff --git a/"), image_path, F.lit(" b/"), image_path,
        F.lit("\nnew file mode 100644\nBinary files /dev/null and b/"), image_path, F.lit(" differ"))
    patch = F.concat_ws("\n", F.concat_ws("\n", head, body), F.when(doc % 4 == 0, note), F.when(doc % 7 == 0, image))
    return base.select(document_hash(doc).alias("commit_hash"), patch.alias("patch"))


def document_commits(documents: DataFrame) -> DataFrame:
    """Commit table that goes with `document_patches`."""
    doc = F.col("doc_id")
    return documents.select(
        document_hash(doc).alias("commit_hash"),
        F.substring_index("text", "\n", 1).alias("message"),
        F.col("source").alias("author"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 60).alias("committed_at"),
        F.when(doc % 2 == 1, F.date_format(F.timestamp_seconds(F.lit(1704067200 + 7200) + doc * 60), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise(F.date_format(F.timestamp_seconds(F.lit(1704067200) + doc * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("committed_date"),
        F.when(doc > 0, document_hash(doc - 1)).alias("parent_hash"),
        (doc % 50 == 49).alias("is_merge"))


def document_log(documents: DataFrame) -> DataFrame:
    """`document_commits` with their patches as the text of a log, one commit a row; merges show no patch."""
    commits = document_commits(documents).join(document_patches(documents), "commit_hash")
    parent = F.coalesce(F.concat(F.lit(" "), _long_hash(F.col("parent_hash"))), F.lit(""))
    second = F.when(F.col("is_merge"), F.concat(F.lit(" "), F.repeat(F.lit("0"), 40))).otherwise("")
    message = F.array_join(F.transform(F.split("message", "\n"), lambda x: F.concat(F.lit("    "), x)), "\n")
    head = F.concat(F.lit("commit "), _long_hash(F.col("commit_hash")), parent, second, F.lit("\nAuthor: "), F.col("author"),
                    F.lit(" <mail@host>\nDate:   "), F.col("committed_date"), F.lit("\n\n"), message, F.lit("\n"))
    return commits.select(F.when(F.col("is_merge"), head).otherwise(F.concat(head, F.lit("\n"), F.col("patch"))).alias("value"))


def _long_hash(value: Column) -> Column:
    """A 40-digit hash from one of 32 digits."""
    return F.concat(value, F.substring(value, 1, 8))


# Code snippets with known syntax, each document takes the one of its number.
SNIPPETS = (
    "for i in range(3):\n    pass",
    "def fact(n):\n    if n <= 1:\n        return 1\n    return n * fact(n - 1)",
    "def f(a, b):\n    try:\n        if a:\n            x = g(h(a))\n        elif b:\n            x = 2\n        else:\n"
    "            x = 3\n    except ValueError:\n        raise\n    return x",
    "import os\n\ndef one(p):\n    q = p + 1\n    return q\n\ndef two(p):\n    r = one(p)\n    print(r)\n    return r\nz = two(4)",
    "class A:\n    def m(self):\n        def inner(v):\n            w = v\n            return w\n        while True:\n"
    "            for k in [1]:\n                with open('f') as fh:\n                    inner(k)\n        else:\n"
    "            if k:\n                pass",
    "# note\n    x = 1\n    y = x",
    "def (:\n  ===",
    "print(1)  # TODO\nwhile x:\n    if x:\n        print(22)\nfrom m import *",
)


def document_snippets(documents: DataFrame) -> DataFrame:
    """(doc_id, code): a snippet, then the lines of the document as comments (control characters as blanks)."""
    snippet = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(
        F.lit("# "), F.regexp_replace(x, F.lit(r"[\x00-\x1f\x7f-\x9f]"), F.lit(" "))))
    return documents.select("doc_id", F.concat(snippet, F.lit("\n"), F.array_join(lines, "\n")).alias("code"))


def code_line(line: Column, i: Column, doc: Column) -> Column:
    """A statement for line `i` of a document, carrying the line's ASCII letters, digits and spaces."""
    w = F.regexp_replace(line, F.lit("[^A-Za-z0-9 ]"), F.lit(""))
    n = _s(i)
    return (
        F.when(i % 6 == 0, F.concat(F.lit("def f"), n, F.lit("(p):\n    q = p + 1\n    return q")))
        .when(i % 6 == 1, F.concat(F.lit("f"), _s(i - 1), F.lit("('"), w, F.lit("')")))
        .when(i % 6 == 2, F.concat(F.lit("if x"), n, F.lit(":\n    y = '"), w, F.lit("'")))
        .when(i % 6 == 3, F.concat(F.lit("for v in r"), n,
                                   F.lit(":\n    while v:\n        if v:\n            print(len(v))")))
        .when(i % 6 == 4, F.concat(F.when(doc % 3 == 0, "# TODO ").otherwise("# "), w))
        .otherwise(F.concat(F.lit("class C"), n, F.lit(':\n    "'), w,
                            F.lit('"\n    def m(self):\n        return f'), _s(i - 5), F.lit("(self)"))))


def document_code(documents: DataFrame) -> DataFrame:
    """(doc_id, code): every line of the document turned into a statement; every fifth document also imports all."""
    doc = F.col("doc_id")
    statements = F.transform(F.split("text", "\n"), lambda x, i: code_line(x, i, doc))
    code = F.concat(F.when(doc % 5 == 0, "from m import *\n").otherwise(""), F.array_join(statements, "\n"))
    return documents.select("doc_id", "lang", "source", code.alias("code"))


def code_hunks(documents: DataFrame) -> DataFrame:
    """`document_code` as hunks: the code is added, the text's lines are the context, every second line was removed."""
    lines = F.split("text", "\n")
    doc = F.col("doc_id")
    statements = F.transform(lines, lambda x, i: code_line(x, i, doc))
    text = F.concat(F.when(doc % 5 == 0, "from m import *\n").otherwise(""), F.array_join(statements, "\n"))
    return documents.select(
        "doc_id", "lang",
        document_hash(doc).alias("commit_hash"), F.lit(0).alias("file_idx"), F.lit(0).alias("hunk_idx"),
        F.concat(F.lit("src/doc_"), _s(doc), F.lit(".py")).alias("file_path"),
        F.split(text, "\n").alias("added_lines"),
        F.filter(lines, lambda x, i: i % 2 == 1).alias("removed_lines"),
        lines.alias("context_lines"))


def event_edges(events: DataFrame) -> DataFrame:
    """Small graphs: per user and week, an edge from the event's type to the type its property k points at.

    Each event gives one edge inside its own row; the distinct keeps at most 25 edges per graph, combined on the map
    side, so a user with very many events costs nothing extra.
    """
    kinds = F.array(*[F.lit(k) for k in EVENT_TYPES])
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_trunc("week", "ts").cast("date").cast("string"))
        .alias("graph_id"),
        F.col("event_type").alias("src"),
        F.element_at(kinds, k % 5 + 1).alias("dst")).distinct()


# Event types of the events table, in alphabetical order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def binary_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Label against a coarse score from the document's length (many ties)."""
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 1)
    return labels.join(documents.select("doc_id", score.alias("probability")), "doc_id").select(
        "doc_id", F.col("quality").cast("int").alias("label"), "probability",
        (F.col("probability") > 0.5).cast("int").alias("prediction"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the next turn when that is the assistant's."""
    user = conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                       F.col("text").alias("generated"))
    reply = conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reference"))
    return user.join(reply, ["conv_id", "turn"])
