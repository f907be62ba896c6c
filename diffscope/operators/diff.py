"""Unified-diff parsing as array expressions.

A patch row is split at file headers and a file at hunk headers with look-ahead patterns, and lines are classified with
array functions. Everything happens inside the row that holds the patch: no shuffle, no window, and the commit context
(files, hunks, added lines) is known before anything is exploded. A commit with very many hunks therefore costs one
row's work, never a hot shuffle partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffscope.functions.text import let, splitlines

# File extensions read by default.
DEFAULT_EXTENSIONS = (".py", ".html", ".css", ".js", ".json", ".md")
PLACEHOLDER_LINE = "[New file or binary change]"

# Either path may be quoted, then with C-style escapes.
QUOTED = r'"%s/((?:[^"\\]|\\.)*)"'
FILE_HEADER = rf"(?d)^diff --git (?:{QUOTED % 'a'}|a/(.*?)) (?:{QUOTED % 'b'}|b/(.*))"
FILE_BREAK = r'\n(?=diff --git "?a/[^\n]*? "?b/)'
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
HUNK_BREAK = r"\n(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"

CONTEXT_COLUMNS = ("files_changed", "total_hunks", "commit_size")


def has_extension(path: Column, extensions) -> Column:
    return reduce(lambda a, b: a | b, [path.endswith(e) for e in extensions], F.lit(False))


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


# The escapes of quoted paths and their bytes; other bytes are three octal digits.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}


def unquote_path(path: Column) -> Column:
    """The path that a quoted one stands for."""
    parts = F.regexp_extract_all(path, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def as_hex(part):
        code = F.substring(part, 2, 3)
        return F.when(part.rlike(r"^\\[0-7]{3}$"), F.lpad(F.conv(code, 8, 16), 2, "0")).when(
            part.startswith("\\"), F.coalesce(known[F.substring(part, 2, 1)], F.hex(F.substring(part, 2, 1)))).otherwise(
            F.hex(part))

    return F.unhex(F.array_join(F.transform(parts, as_hex), "")).cast("string")


def _path(header: Column, quoted: int) -> Column:
    """Path of a file header from its quoted group or the plain group that follows it."""
    inside = F.regexp_extract(header, FILE_HEADER, quoted)
    return F.when(inside != "", unquote_path(inside)).otherwise(F.regexp_extract(header, FILE_HEADER, quoted + 1))


def file_sections(patch: Column) -> Column:
    """ARRAY<STRING>: the text of each file's part of a patch, headers included."""
    return F.filter(F.split(patch, FILE_BREAK), lambda x: x.rlike(FILE_HEADER))


def _file_struct(section: Column) -> Column:
    def described(parts: Column) -> Column:
        return let(F.element_at(parts, 1), lambda header: _header_struct(section, header, parts))

    return let(F.split(section, HUNK_BREAK), described)


def _header_struct(section: Column, header: Column, parts: Column) -> Column:
    first = _first_line(header)
    old, new = _path(first, 1), _path(first, 3)
    return F.struct(
        F.when(new == "/dev/null", old).otherwise(new).alias("file_path"),
        old.alias("old_file"),
        new.alias("new_file"),
        F.when(header.rlike(r"(?dm)^deleted file mode"), "D")
        .when(header.rlike(r"(?dm)^new file mode"), "A").when(header.rlike(r"(?dm)^rename from "), "R")
        .when(header.rlike(r"(?dm)^copy from "), "C").otherwise("M").alias("change_type"),
        header.rlike(r"(?dm)^(Binary files |GIT binary patch)").alias("is_binary"),
        section.alias("diff"),
        parts.alias("parts"),
    )


def _count(head: Column, group: int) -> Column:
    text = F.regexp_extract(head, HUNK_HEADER, group)
    return F.when(text == "", F.lit(1)).otherwise(text.try_cast("int"))


def _body_length(raw: Column, old_count: Column, new_count: Column) -> Column:
    """Lines of `raw` that the header counts cover."""
    start = F.struct(F.lit(0).alias("o"), F.lit(0).alias("n"), F.lit(0).alias("k"))

    def step(acc, x):
        old = acc["o"] + (x.startswith("-") | x.startswith(" ") | (x == "")).cast("int")
        new = acc["n"] + (x.startswith("+") | x.startswith(" ") | (x == "")).cast("int")
        done = (acc["o"] >= old_count) & (acc["n"] >= new_count)
        return F.when(done, acc).otherwise(F.struct(old.alias("o"), new.alias("n"), (acc["k"] + 1).alias("k")))

    return F.aggregate(raw, start, step, lambda acc: acc["k"])


def _hunk_struct(part: Column, compat: bool) -> Column:
    return let(F.split(part, "\n"), lambda lines: let(
        F.element_at(lines, 1), lambda head: _hunk_fields(head, lines, compat)))


def _hunk_fields(head: Column, lines: Column, compat: bool) -> Column:
    raw = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    old_count, new_start, new_count = _count(head, 2), _count(head, 3), _count(head, 4)
    body = raw if compat else F.slice(raw, F.lit(1), _body_length(raw, old_count, new_count))

    def added(x: Column) -> Column:
        return x.startswith("+") & ~x.startswith("+++") if compat else x.startswith("+")

    def removed(x: Column) -> Column:
        return x.startswith("-") & ~x.startswith("---") if compat else x.startswith("-")

    def content(of: Column) -> Column:
        def pick(test):
            return F.transform(F.filter(of, test), lambda x: F.substring(x, 2, 2147483647))

        return F.struct(
            F.lit("hunk").alias("hunk_type"),
            _count(head, 1).alias("old_start"),
            old_count.alias("old_count"),
            new_start.alias("new_start"),
            new_count.alias("new_count"),
            new_start.alias("line_start"),
            (new_start + new_count - 1).alias("line_end"),
            pick(added).alias("added_lines"),
            pick(removed).alias("removed_lines"),
            pick(lambda x: x.startswith(" ")).alias("context_lines"),
            raw.alias("raw_lines"),
        )

    return let(body, content)


def _placeholder_struct() -> Column:
    none, empty = F.lit(None).cast("int"), F.array().cast("array<string>")
    return F.struct(
        F.lit("new_file").alias("hunk_type"),
        *[none.alias(c) for c in ("old_start", "old_count", "new_start", "new_count")],
        F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
        F.array(F.lit(PLACEHOLDER_LINE)).alias("added_lines"),
        empty.alias("removed_lines"), empty.alias("context_lines"), empty.alias("raw_lines"),
    )


def _hunks_of(parts: Column, change_type: Column, is_binary: Column, placeholder: bool, compat: bool) -> Column:
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    hunks = F.transform(bodies, lambda p: _hunk_struct(p, compat))
    if not placeholder:
        return hunks
    missing = (F.size(hunks) == 0) & ((change_type == "A") | is_binary)
    return F.when(missing, F.array(_placeholder_struct())).otherwise(hunks)


def parse_files(patches: DataFrame, extensions=DEFAULT_EXTENSIONS, drop_binary: bool = False) -> DataFrame:
    """One row per changed file of each patch: path, change type and the file's diff text."""
    files = F.transform(file_sections(F.col("patch")), _file_struct)
    if extensions:
        files = F.filter(files, lambda f: has_extension(f["file_path"], extensions))
    if drop_binary:
        files = F.filter(files, lambda f: ~f["is_binary"])
    kept = [c for c in patches.columns if c != "patch"]
    return _explode(patches, kept, files, "file_idx", "f").select(
        *kept, "file_idx", *[f"f.{c}" for c in ("file_path", "old_file", "new_file", "change_type", "is_binary", "diff")])


def _explode_hunks(df: DataFrame, keys: list[str], hunks: Column) -> DataFrame:
    return _explode(df, keys, hunks, "hunk_idx", "h").select(*keys, "hunk_idx", "h.*")


def _explode(df: DataFrame, keys: list[str], items: Column, index: str, item: str) -> DataFrame:
    """posexplode without the not-empty filter that the optimizer would derive from it: that filter would repeat the
    whole parse below the explode."""
    return df.select(*keys, F.posexplode_outer(items).alias(index, item)).where(F.col(index).isNotNull())


def parse_hunks(file_diffs: DataFrame, placeholder: bool = True, compat: bool = False) -> DataFrame:
    """One row per hunk of a file-diff table made by `parse_files`.

    `placeholder` adds one row for new or binary files without hunks. The header's line counts say which lines belong
    to a hunk; `compat` takes lines starting `+++` or `---` for headers instead and drops them.
    """
    keys = [c for c in file_diffs.columns if c not in ("diff", "is_binary")]
    hunks = _hunks_of(F.split(F.col("diff"), HUNK_BREAK), F.col("change_type"), F.col("is_binary"), placeholder, compat)
    return _explode_hunks(file_diffs, keys, hunks)


def patch_hunks(patches: DataFrame, extensions=DEFAULT_EXTENSIONS, placeholder: bool = True,
                compat: bool = False) -> DataFrame:
    """Patches straight to hunks, with the commit context columns computed inside the patch row."""
    files = F.transform(file_sections(F.col("patch")), _file_struct)
    if extensions:
        files = F.filter(files, lambda f: has_extension(f["file_path"], extensions))
    full = F.transform(files, lambda f: F.struct(
        f["file_path"].alias("file_path"), f["change_type"].alias("change_type"),
        _hunks_of(f["parts"], f["change_type"], f["is_binary"], placeholder, compat).alias("hunks")))
    kept = [c for c in patches.columns if c != "patch"]

    def total(of):
        return F.aggregate(F.col("_files"), F.lit(0), lambda acc, f: acc + of(f))

    def added(f):
        return F.aggregate(f["hunks"], F.lit(0), lambda acc, h: acc + F.size(h["added_lines"]))

    context = patches.select(*kept, full.alias("_files")).select(
        *kept, "_files",
        F.size("_files").alias("files_changed"),
        total(lambda f: F.size(f["hunks"])).alias("total_hunks"),
        total(added).alias("commit_size"))
    per_file = _explode(context, [*kept, *CONTEXT_COLUMNS], F.col("_files"), "file_idx", "f").select(
        *kept, *CONTEXT_COLUMNS, "file_idx", "f.*")
    keys = [c for c in per_file.columns if c != "hunks"]
    return _explode_hunks(per_file, keys, F.col("hunks"))


def with_commit_context(hunks: DataFrame, commit: str = "commit_hash") -> DataFrame:
    """Add the commit context to a hunk table that lacks it.

    A partial aggregation gives one narrow row per commit, joined back; adaptive execution broadcasts it when small and
    splits the partition of a commit that holds very many hunks. Where only counts of lines go on, replace the line arrays
    by their counts first (`line_counts`), so that no text is shuffled.
    """
    if "added_lines" not in hunks.columns:
        added = F.col("n_added")
    else:
        added = F.size("added_lines")
    per_commit = hunks.groupBy(commit).agg(
        F.count_distinct("file_idx").cast("int").alias("files_changed"),
        F.count(F.lit(1)).cast("int").alias("total_hunks"),
        F.sum(added).cast("int").alias("commit_size")).withColumnRenamed(commit, "_commit")
    plain = hunks.drop(*CONTEXT_COLUMNS)
    return plain.join(per_commit, plain[commit].eqNullSafe(per_commit["_commit"]), "left").drop("_commit")


def line_counts(hunks: DataFrame) -> DataFrame:
    """Hunks with n_added, n_removed and n_context instead of the line arrays."""
    return hunks.withColumns({f"n_{k}": F.size(f"{k}_lines") for k in ("added", "removed", "context")}).drop(
        "added_lines", "removed_lines", "context_lines", "raw_lines")


def full_file_hunks(files: DataFrame, path: str = "path", content: str = "value") -> DataFrame:
    """A whole file as one hunk in which every line is added."""
    lines = splitlines(F.col(content))
    empty = F.array().cast("array<string>")
    return files.select(
        F.lit(None).cast("string").alias("commit_hash"),
        F.col(path).alias("file_path"),
        F.lit(0).alias("file_idx"), F.lit(0).alias("hunk_idx"),
        F.lit("full_file").alias("hunk_type"),
        F.lit(1).alias("line_start"), F.size(lines).alias("line_end"),
        lines.alias("added_lines"), empty.alias("removed_lines"), empty.alias("context_lines"))


def snapshot_patch(path: Column, change_type: Column, content: Column) -> Column:
    """Patch text of a wholly added (A) or deleted (D) file, made from its content. Other kinds need both versions: an error."""
    change_type = F.when(change_type.isin("A", "D"), change_type).otherwise(
        F.raise_error(F.lit("a snapshot is added (A) or deleted (D)")))
    sign = F.when(change_type == "D", "-").otherwise("+")
    lines = F.split(content, "\n")
    n = F.size(lines).cast("string")
    zero, span = F.lit("0,0"), F.concat(F.lit("1,"), n)
    added = change_type != "D"
    return F.concat_ws(
        "\n",
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path),
        F.when(added, "new file mode 100644").otherwise("deleted file mode 100644"),
        F.when(added, "--- /dev/null").otherwise(F.concat(F.lit("--- a/"), path)),
        F.when(added, F.concat(F.lit("+++ b/"), path)).otherwise("+++ /dev/null"),
        F.concat(F.lit("@@ -"), F.when(added, zero).otherwise(span), F.lit(" +"),
                 F.when(added, span).otherwise(zero), F.lit(" @@")),
        F.array_join(F.transform(lines, lambda x: F.concat(sign, x)), "\n"))


def _counted_files(extensions) -> Column:
    files = F.transform(file_sections(F.col("patch")), _file_struct)
    if extensions:
        files = F.filter(files, lambda f: has_extension(f["file_path"], extensions))

    def lines(f, column):
        hunks = _hunks_of(f["parts"], f["change_type"], f["is_binary"], False, False)
        return F.aggregate(hunks, F.lit(0), lambda acc, h: acc + F.size(h[column]))

    return F.transform(files, lambda f: F.struct(
        f["file_path"].alias("file_path"), f["change_type"].alias("change_type"),
        lines(f, "added_lines").alias("insertions"), lines(f, "removed_lines").alias("deletions")))


def patch_file_stats(patches: DataFrame, extensions=None) -> DataFrame:
    """Insertions and deletions of every file of each patch, binary and empty ones included (0), in the patch row."""
    return _explode(patches, ["commit_hash"], _counted_files(extensions), "_at", "f").select("commit_hash", "f.*")


def patch_commit_stats(patches: DataFrame, extensions=None) -> DataFrame:
    """Totals of each patch over all its files, in the patch row; a patch without files has zeros."""
    def total(column):
        return F.aggregate("_files", F.lit(0), lambda acc, f: acc + f[column])

    return patches.select("commit_hash", _counted_files(extensions).alias("_files")).select(
        "commit_hash", total("insertions").alias("total_insertions"), total("deletions").alias("total_deletions"),
        F.size(F.array_distinct(F.transform("_files", lambda f: f["file_path"]))).alias("files_changed"))


def file_stats(hunks: DataFrame) -> DataFrame:
    """Insertions and deletions per commit and file of a hunk table (files without hunks are not in it)."""
    return hunks.groupBy("commit_hash", "file_path", "change_type").agg(
        F.sum(F.size("added_lines")).alias("insertions"),
        F.sum(F.size("removed_lines")).alias("deletions"))


def commit_stats(hunks: DataFrame) -> DataFrame:
    """Totals per commit of a hunk table (commits without hunks are not in it)."""
    return hunks.groupBy("commit_hash").agg(
        F.sum(F.size("added_lines")).alias("total_insertions"),
        F.sum(F.size("removed_lines")).alias("total_deletions"),
        F.count_distinct("file_path").alias("files_changed"))


def hunk_key(df: DataFrame) -> Column:
    """Stable snippet id of a hunk row."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("commit_hash", "file_path", "file_idx", "hunk_idx")
             if c in df.columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
