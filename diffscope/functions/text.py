"""Column functions for text, line and regular-expression metrics (Python text semantics on JVM regular expressions).

Spark's `trim` and `\\s`, `\\w`, `\\b`, `.` and `$` differ from Python's, so every pattern here states its classes
explicitly: WS is what `str.strip` removes, WORD is what `\\w` matches, and `(?d)` makes only `\\n` a line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


def _word(body: str) -> str:
    """`\\b(body)\\b` with Unicode word boundaries, for a body that starts and ends with a word character."""
    return f"(?<!{WORD})(?:{body})(?!{WORD})"


def let(value: Column, body) -> Column:
    """Bind `value` to a lambda variable, so that it is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_py(text: Column) -> Column:
    """`str.strip()`."""
    return F.regexp_replace(text, F.lit(f"(?U)^{WS}+|{WS}+$"), F.lit(""))


def ltrim_py(text: Column) -> Column:
    """`str.lstrip()`."""
    return F.regexp_replace(text, F.lit(f"(?U)^{WS}+"), F.lit(""))


def not_blank(text: Column) -> Column:
    """True if the text has any non-whitespace character."""
    return text.rlike(f"(?U){NOT_WS}")


def splitlines(text: Column) -> Column:
    """`str.splitlines()`: all Unicode line ends, no trailing empty element."""
    parts = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def word_count(text: Column) -> Column:
    """`len(text.split())`."""
    return F.regexp_count(text, F.lit(f"(?U){NOT_WS}+"))


def has_added_text(lines: Column) -> Column:
    """True if any line is non-blank."""
    return F.exists(lines, not_blank)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def clean_code(code: Column) -> Column:
    """Collapse blank lines, strip `#` tails and triple-quoted blocks, trim. Steps are applied in this order."""
    for pattern, new in (
        (rf"(?U)\n{WS}*\n", "\n"),
        (r"(?d)#.*", ""),
        (r'(?s)""".*?"""', ""),
        (r"(?s)'''.*?'''", ""),
    ):
        code = F.regexp_replace(code, F.lit(pattern), F.lit(new))
    return trim_py(code)


def token_count(code: Column, limit: int | None = None) -> Column:
    """Number of word or punctuation tokens, at most `limit` if one is given."""
    count = F.regexp_count(code, F.lit(rf"(?U){WORD}+|[^\s\p{{L}}\p{{N}}_\x1c-\x1f]"))
    return count if limit is None else F.least(F.lit(limit), count)


def count_nonblank(lines: Column) -> Column:
    return F.size(F.filter(lines, not_blank))


def count_comments(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(f"(?U)^{WS}*#")))


def line_lengths(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.length(x))


def array_total(values: Column) -> Column:
    """Sum of an integer array as LONG, 0 when empty."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def indents(lines: Column) -> Column:
    """Leading whitespace characters of each non-blank line (a tab counts one)."""
    return F.transform(F.filter(lines, not_blank), lambda x: F.length(x) - F.length(ltrim_py(x)))


def jaccard_words(left: Column, right: Column) -> Column:
    """Jaccard similarity of the lower-cased word sets; 0 if either set is empty."""
    def words(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), F.lit(0)))

    def similarity(a: Column, b: Column) -> Column:
        total = F.size(a) + F.size(b)
        shared = let(F.size(F.array_intersect(a, b)), lambda both: both / (total - both))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared)

    left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    return let(words(left), lambda a: let(words(right), lambda b: similarity(a, b)))


def line_metrics(lines: Column) -> dict[str, Column]:
    """Line part of the basic code metrics."""
    lengths = line_lengths(lines)
    nonblank = count_nonblank(lines)
    return {
        "lines_of_code": nonblank,
        "total_lines": F.size(lines),
        "comment_lines": count_comments(lines),
        "blank_lines": F.size(lines) - nonblank,
        "max_line_length": F.coalesce(F.array_max(lengths), F.lit(0)),
        "avg_line_length": F.coalesce(F.try_divide(array_total(lengths).cast("double"), F.size(lines).cast("double")),
                                      F.lit(0.0)),
    }


# Patterns counted in the added code.
COUNT_PATTERNS = {
    "conditional_statements": _word("if|elif"),
    "loop_statements": _word("for|while"),
    "exception_handling": _word("try|except|finally"),
    "debug_prints": rf"(?U)print{WS}*\(",
    "todo_comments": r"(?iu)TODO|FIXME|XXX",
    "magic_numbers": _word(r"\p{Nd}{2,}"),
}
FLAG_PATTERNS = {
    "has_functions": _word("def"),
    "has_classes": _word("class"),
    "has_imports": rf"(?dmU)^{WS}*(import|from)",
}


def regex_features(code: Column) -> dict[str, Column]:
    """Flags and counts found by pattern in the added code."""
    flags = {name: code.rlike(p).cast("int") for name, p in FLAG_PATTERNS.items()}
    counts = {name: F.regexp_count(code, F.lit(p)) for name, p in COUNT_PATTERNS.items()}
    return {**flags, **counts}


def volume_features(added: Column, removed: Column, code: Column) -> dict[str, Column]:
    return {"lines_added": count_nonblank(added), "total_chars": F.length(code), "lines_removed": F.size(removed)}


def length_features(added: Column) -> dict[str, Column]:
    lengths = line_lengths(added)
    n = F.greatest(F.lit(1), F.size(added)).cast("double")
    return {
        "comment_density": count_comments(added) / n,
        "avg_line_length": array_total(lengths) / n,
        "max_line_length": F.coalesce(F.array_max(lengths), F.lit(0)),
    }


def indent_features(indent: Column) -> dict[str, Column]:
    """From an array made by `indents`."""
    return {
        "max_indentation": F.coalesce(F.array_max(indent), F.lit(0)),
        "indent_variance": F.size(F.array_distinct(indent)),
        "avg_indentation": F.coalesce(F.try_divide(array_total(indent).cast("double"), F.size(indent).cast("double")),
                                      F.lit(0.0)),
    }


def preview(code: Column, width: int = 200) -> Column:
    """First `width` characters, with dots if there are more."""
    return F.when(F.length(code) > width, F.concat(F.substring(code, 1, width), F.lit("..."))).otherwise(code)
