"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every file is addressed by the SHA-256 of its text. The ledger holds one row per (blob, rule, rule
version) that was ever scanned, with the spans found, an empty list included. A run scans only the pairs the ledger
lacks, appends them, and joins the spans back to every path whose version has that blob. A blob is scanned once however
many copies there are, and a changed rule is scanned again under its new version only.

Defined cases: a null text is an empty text; null ids are kept; repeated rows each get their findings; a text of any
length is scanned whole; an empty table gives an empty result. Other columns of the input are not used, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffscope.llm.store import shared_folder, written


@dataclass(frozen=True)
class Rule:
    """`pattern` is matched leftmost, without overlaps; matches whose `group` is shorter than `at_least` are dropped."""

    kind: str
    pattern: str
    at_least: int
    group: int = 0
    version: int = 1


# The three rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # maximal runs, so the same matches as of shorter runs that are then dropped
)

SPAN = "struct<start:int,end:int>"
LEDGER = T.StructType([
    T.StructField("blob", T.BinaryType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                     T.StructField("end", T.IntegerType())])))])


def _read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None:
        return spark.createDataFrame([], LEDGER)
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def _pieces(rule: Rule, text: Column) -> Column:
    """Per match: length of the text since the match before (gap), of the match, and whether it is long enough."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def piece(match, gap):
        part = match if rule.group == 0 else F.regexp_extract(match, rule.pattern, rule.group)
        return F.struct(F.length(gap).alias("gap"), F.length(match).alias("length"),
                        (F.length(part) >= rule.at_least).alias("keep"))

    zipped = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), piece)
    return F.when(text.rlike(rule.pattern), zipped)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of `blobs` (blob, text, todo: array of kinds to scan), one row per blob and kind.

    Offsets are code points. They are running sums over the pieces of one text, so a text with very many matches costs
    in proportion to them.
    """
    found = blobs.select("blob", F.array(*[
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                 F.when(F.array_contains("todo", r.kind), _pieces(r, F.col("text"))).alias("pieces"))
        for r in rules]).alias("found"), "todo")
    found = found.dropDuplicates(["blob"])
    rows = found.select("blob", "todo", F.explode("found").alias("f")).where(F.array_contains("todo", F.col("f.rule")))
    pieces = rows.select("blob", "f.rule", "f.version", F.posexplode_outer("f.pieces").alias("i", "p"))
    ends = F.expr("sum(p.gap + p.length) over (partition by blob, rule order by i rows unbounded preceding)").cast("int")
    spans = pieces.select("blob", "rule", "version", "i", F.col("p.keep").alias("keep"), F.col("p.length").alias("length"),
                          ends.alias("end"))
    span = F.when(F.col("keep"), F.struct((F.col("end") - F.col("length")).alias("start"), F.col("end").alias("end")))
    return spans.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def find_secrets(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None,
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `versions`: id, blob, `spans` array of (start, kind number, kind, end), sorted.

    `ledger` is the folder of the ledger table and is appended to. None starts an empty ledger in the shared folder.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = versions.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    paths = written(keyed.select("id", "blob"), "secret-paths")
    kinds = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules]))
    firsts = paths.groupBy("blob").agg(F.min("id").alias("id"))
    wanted = firsts.select("blob", "id", kinds.alias("r")).select("blob", "id", "r.rule", "r.version")
    seen = _read_ledger(spark, ledger).select("blob", "rule", "version")
    todo = wanted.join(seen, ["blob", "rule", "version"], "left_anti").groupBy("blob", "id").agg(
        F.collect_set("rule").alias("todo"))
    same = keyed["blob"].eqNullSafe(todo["blob"]) & keyed["id"].eqNullSafe(todo["id"])
    unseen = keyed.join(todo, same).select(keyed["blob"], "text", "todo")
    folder = ledger or shared_folder(spark, "secret-ledger")
    scan(unseen, rules).write.mode("append").parquet(folder)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    known = spark.read.schema(LEDGER).parquet(folder).where(F.col("version") == current[F.col("rule")])
    found = known.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list(F.transform(
        "spans", lambda s: F.struct(s.start.alias("start"), order[F.col("rule")].alias("number"),
                                    F.col("rule").alias("kind"), s.end.alias("end"))))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,number:int,kind:string,end:int>>)")
    return paths.join(found, "blob", "left").select(
        "id", "blob", F.coalesce(F.array_sort("spans"), none).alias("spans"))


def redact(texts: DataFrame, text_col: str = "text", spans_col: str = "spans", mark: str = "[secret]") -> DataFrame:
    """Replace what the spans cover by `mark`; overlapping spans are replaced together. `spans_col` is dropped."""
    start = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    merged = F.aggregate(spans_col, start, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1).end > s.start),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1).start.alias("start"), F.greatest(F.element_at(acc, -1).end, s.end).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(s.start.alias("start"), s.end.alias("end"))))))
    text = F.col(text_col)
    marked = texts.withColumn("_merged", merged)
    clean = F.concat(
        F.array_join(F.transform("_merged", lambda s, i: F.concat(
            F.substring(text, F.when(i == 0, F.lit(0)).otherwise(F.get("_merged", i - 1).end) + 1,
                        s.start - F.when(i == 0, F.lit(0)).otherwise(F.get("_merged", i - 1).end)), F.lit(mark))), ""),
        F.substring(text, F.element_at("_merged", -1).end + 1, F.length(text)))
    return marked.withColumn(text_col, F.when(F.size("_merged") > 0, clean).otherwise(text)).drop("_merged", spans_col)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The query's columns: counts per kind, digest and text of all spans."""
    label = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *[count(r.kind) for r in rules],
                        F.sha2(label, 256).alias("base_sha256"), label.alias("spans"))


# The same findings in DuckDB; letters in both cases are spelled out, as its case-insensitive mode folds other letters too.
_ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
           "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")


def _sql_spans(number: int, kind: str, pattern: str, value: str, least: int) -> str:
    return f"""
      SELECT doc_id, {number} AS number, '{kind}' AS kind, m[i] AS hit, CAST(
             list_sum(list_transform(gaps[1:i], lambda x: length(x))) +
             coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, m, gaps, unnest(generate_series(1, len(m))) AS i FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS gaps
            FROM texts WHERE regexp_matches(t, '{pattern}')))
      WHERE length({value}) >= {least}"""


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_sql_spans(0, 'assign', _ASSIGN, f"regexp_extract(m[i], '{_ASSIGN}', 2)", 6)}
  UNION ALL {_sql_spans(1, 'access', 'AKIA[A-Z0-9]+', 'm[i]', 20)}
  UNION ALL {_sql_spans(2, 'hex', '[0-9a-f]{24,}', 'm[i]', 24)}),
joined AS (SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access,
                  count(*) FILTER (number = 2) AS n_hex,
                  string_agg(kind || ':' || s || ':' || (s + length(hit)), ',' ORDER BY s, number) AS spans
           FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts d LEFT JOIN joined USING (doc_id)"""
