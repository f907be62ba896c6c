"""Reference statements (DuckDB) for the registered queries, written from the meaning of each query, over whole tables."""

from __future__ import annotations

from diffscope.functions.review_text import NO_REMOVED, PROMPT
from diffscope.sources.tables import TEMPLATES

# Lines of each document with the statements that `derive.code_line` makes of them.
_CODE = """
WITH base AS (
  SELECT doc_id, lang, text, string_split(text, chr(10)) AS lines FROM documents),
coded AS (
  SELECT doc_id, lang, lines,
    CASE WHEN doc_id % 5 = 0 THEN 'from m import *' || chr(10) ELSE '' END ||
    array_to_string(list_transform(lines, lambda x, j: CASE (j - 1) % 6
      WHEN 0 THEN 'def f' || (j - 1) || '(p):' || chr(10) || '    q = p + 1' || chr(10) || '    return q'
      WHEN 1 THEN 'f' || (j - 2) || '(''' || regexp_replace(x, '[^A-Za-z0-9 ]', '', 'g') || ''')'
      WHEN 2 THEN 'if x' || (j - 1) || ':' || chr(10) || '    y = ''' || regexp_replace(x, '[^A-Za-z0-9 ]', '', 'g') || ''''
      WHEN 3 THEN 'for v in r' || (j - 1) || ':' || chr(10) || '    while v:' || chr(10) || '        if v:' || chr(10)
                  || '            print(len(v))'
      WHEN 4 THEN (CASE WHEN doc_id % 3 = 0 THEN '# TODO ' ELSE '# ' END) || regexp_replace(x, '[^A-Za-z0-9 ]', '', 'g')
      ELSE 'class C' || (j - 1) || ':' || chr(10) || '    "' || regexp_replace(x, '[^A-Za-z0-9 ]', '', 'g') || '"' || chr(10)
           || '    def m(self):' || chr(10) || '        return f' || (j - 6) || '(self)' END), chr(10)) AS code
  FROM base),
kinds AS (
  SELECT doc_id, lang, lines, code, string_split(code, chr(10)) AS added,
    (len(lines) + 5) // 6 AS c0, (len(lines) + 4) // 6 AS c1, (len(lines) + 3) // 6 AS c2,
    (len(lines) + 2) // 6 AS c3, (len(lines) + 1) // 6 AS c4, len(lines) // 6 AS c5,
    CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS im
  FROM coded)
"""

_LABEL = _CODE + """,
counted AS (
  SELECT *, len(list_filter(added, lambda x: trim(x) <> '')) AS cnt,
    len(list_filter(added, lambda x: regexp_matches(x, '^\\s*#'))) AS comments,
    len(regexp_extract_all(code, '(?m)\\bif\\b.*:\\s*$')) AS p_if,
    len(regexp_extract_all(code, '(?m)\\btry\\b.*:\\s*$')) AS p_try,
    len(regexp_extract_all(code, '(?m)\\bwhile\\b.*:\\s*$')) AS p_while,
    len(regexp_extract_all(code, '(?m)\\bdef\\b.*:\\s*$')) AS p_def,
    len(regexp_extract_all(code, '(?m)\\bclass\\b.*:\\s*$')) AS p_class,
    len(regexp_extract_all(code, 'TODO|FIXME|XXX')) AS p_todo,
    len(regexp_extract_all(code, 'print\\(|console\\.log')) AS p_print,
    len(regexp_extract_all(code, 'import\\s+\\*')) AS p_wild,
    len(list_filter(added, lambda x: length(x) > 100)) AS long_lines,
    len(list_distinct(list_transform(list_filter(added, lambda x: trim(x) <> ''),
        lambda x: length(x) - length(ltrim(x))))) AS variety
  FROM kinds),
scored AS (
  SELECT *, 0.5::DOUBLE
    + (CASE WHEN cnt > 50 THEN -0.2 WHEN cnt > 20 THEN -0.1 ELSE 0 END)::DOUBLE
    + (CASE WHEN comments::DOUBLE / cnt > 0.2::DOUBLE THEN 0.1 WHEN comments = 0 AND cnt > 10 THEN -0.1 ELSE 0 END)::DOUBLE
    + 0.05::DOUBLE * least(p_if, 3) + 0.1::DOUBLE * least(p_try, 3) + (-0.05)::DOUBLE * least(p_while, 3)
    + 0.1::DOUBLE * least(p_def, 3) + 0.15::DOUBLE * least(p_class, 3) + (-0.1)::DOUBLE * least(p_todo, 3)
    + (-0.15)::DOUBLE * least(p_print, 3) + (-0.2)::DOUBLE * least(p_wild, 3)
    - 0.05::DOUBLE * least(long_lines, 5)
    + (CASE WHEN variety > 4 THEN -0.1 ELSE 0 END)::DOUBLE
    + (CASE WHEN c3 > 0 THEN -0.05 ELSE 0 END)::DOUBLE
    + (CASE WHEN c5 > 0 THEN 0.1 ELSE 0 END)::DOUBLE AS raw_score
  FROM counted),
labels_of AS (
  SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, raw_score)) AS score,
    list_filter([CASE WHEN cnt > 50 THEN 'very_long_change' WHEN cnt > 20 THEN 'long_change' END,
      CASE WHEN comments = 0 AND cnt > 10 THEN 'no_comments' END,
      CASE WHEN p_while > 0 THEN 'while_loop_detected' END,
      CASE WHEN p_todo > 0 THEN 'todo_markers_detected' END,
      CASE WHEN p_print > 0 THEN 'debug_prints_detected' END,
      CASE WHEN p_wild > 0 THEN 'wildcard_import_detected' END,
      CASE WHEN long_lines > 0 THEN 'long_lines' END,
      CASE WHEN variety > 4 THEN 'inconsistent_indentation' END], lambda x: x IS NOT NULL) AS issues
  FROM scored)
"""

_PATCH = """
WITH d AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines, doc_id % 5 AS kind,
    'src/' || source || '/doc_' || doc_id || '.' || ['py', 'js', 'md', 'json', 'txt'][(doc_id // 5) % 5 + 1] AS path,
    (doc_id // 5) % 5 < 4 AS kept
  FROM documents),
s AS (
  SELECT *, list_transform(lines, lambda x, j: {'j': j, 'x': x, 's': CASE WHEN kind = 0 THEN '+' WHEN kind = 1 THEN '-'
      WHEN (j - 1) % 3 = 0 THEN '+' WHEN (j - 1) % 3 = 1 THEN '-' ELSE ' ' END}) AS marked,
    CASE WHEN len(lines) > 6 THEN len(lines) // 2 ELSE len(lines) END AS cut FROM d),
parts AS (
  SELECT doc_id, path, kind, 0 AS hunk_idx, list_filter(marked, lambda m: m.j <= cut) AS part, NULL AS prior FROM s WHERE kept
  UNION ALL
  SELECT doc_id, path, kind, 1, list_filter(marked, lambda m: m.j > cut), list_filter(marked, lambda m: m.j <= cut)
  FROM s WHERE kept AND len(lines) > cut
  UNION ALL
  SELECT doc_id, 'docs/note_' || doc_id || '.md', -1, 0,
    list_transform(lines, lambda x, j: {'j': j, 'x': x, 's': '+'}), NULL FROM s WHERE doc_id % 4 = 0),
hunks AS (
  SELECT md5(doc_id::VARCHAR) AS commit_hash, path AS file_path,
    CASE WHEN kind IN (0, -1) THEN 'A' WHEN kind = 1 THEN 'D' ELSE 'M' END AS change_type, 'hunk' AS hunk_type, hunk_idx,
    CASE WHEN kind = -1 THEN 0 ELSE 1 + coalesce(len(list_filter(prior, lambda m: m.s <> '+')), 0) END AS old_start,
    len(list_filter(part, lambda m: m.s <> '+')) AS old_count,
    1 + coalesce(len(list_filter(prior, lambda m: m.s <> '-')), 0) AS new_start,
    len(list_filter(part, lambda m: m.s <> '-')) AS new_count,
    list_transform(list_filter(part, lambda m: m.s = '+'), lambda m: m.x) AS added,
    list_transform(list_filter(part, lambda m: m.s = '-'), lambda m: m.x) AS removed,
    list_transform(list_filter(part, lambda m: m.s = ' '), lambda m: m.x) AS context
  FROM parts
  UNION ALL
  SELECT md5(doc_id::VARCHAR), 'img/pic_' || doc_id || '.css', 'A', 'new_file', 0, NULL, NULL, NULL, NULL,
    ['[New file or binary change]'], [], [] FROM s WHERE doc_id % 7 = 0),
ctx AS (
  SELECT commit_hash, count(DISTINCT file_path) AS files_changed, count(*) AS total_hunks, sum(len(added))::BIGINT AS commit_size
  FROM hunks GROUP BY 1),
files AS (
  SELECT md5(doc_id::VARCHAR) AS commit_hash, path AS file_path,
    CASE WHEN kind = 0 THEN 'A' WHEN kind = 1 THEN 'D' ELSE 'M' END AS change_type, 0 AS is_binary FROM s WHERE kept
  UNION ALL SELECT md5(doc_id::VARCHAR), 'docs/note_' || doc_id || '.md', 'A', 0 FROM s WHERE doc_id % 4 = 0
  UNION ALL SELECT md5(doc_id::VARCHAR), 'img/pic_' || doc_id || '.css', 'A', 1 FROM s WHERE doc_id % 7 = 0),
commits AS (
  SELECT md5(doc_id::VARCHAR) AS commit_hash, string_split(text, chr(10))[1] AS message, source AS author, doc_id,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS date,
    CASE WHEN doc_id % 2 = 1 THEN strftime(TIMESTAMP '2024-01-01 02:00:00' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S+02:00')
      ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%SZ') END AS own_date FROM documents)
"""

# All files of a patch, those outside the default extensions and binary ones included.
_STATS = _PATCH.replace("FROM s WHERE kept AND", "FROM s WHERE").replace(" FROM s WHERE kept", " FROM s").rstrip() + """,
every_file AS (
  SELECT commit_hash, file_path, change_type, sum(CASE WHEN hunk_type = 'hunk' THEN len(added) ELSE 0 END)::BIGINT AS insertions,
    sum(len(removed))::BIGINT AS deletions FROM hunks GROUP BY ALL)
"""

_RECENT = "commit_hash AS hash, substr(commit_hash, 1, 8) AS short_hash, message, author, own_date AS date"

# Small graphs of event types, all shortest paths by enumerating simple paths (at most five nodes).
_GRAPH = """
WITH RECURSIVE ev AS (
  SELECT user_id::VARCHAR || '-' || (date_trunc('week', ts)::DATE)::VARCHAR AS graph_id, event_type AS src,
    json_extract(props, '$.k')::INT AS k FROM events),
e AS (SELECT DISTINCT graph_id, src, ['click', 'error', 'purchase', 'signup', 'view'][k % 5 + 1] AS dst FROM ev),
n AS (SELECT DISTINCT graph_id, unnest([src, dst]) AS node FROM e),
sz AS (SELECT graph_id, count(*) AS num_nodes FROM n GROUP BY 1),
und AS (SELECT DISTINCT graph_id, src, dst FROM (
  SELECT graph_id, src, dst FROM e WHERE src <> dst UNION ALL SELECT graph_id, dst, src FROM e WHERE src <> dst)),
walk AS (
  SELECT graph_id, node AS s, node AS t, 0 AS dist, [node] AS seen FROM n
  UNION ALL
  SELECT w.graph_id, w.s, x.dst, w.dist + 1, list_append(w.seen, x.dst)
  FROM walk w JOIN {edges} x ON x.graph_id = w.graph_id AND x.src = w.t WHERE NOT list_contains(w.seen, x.dst)),
best AS (SELECT graph_id, s, t, min(dist) AS dist FROM walk GROUP BY ALL),
paths AS (SELECT b.graph_id, b.s, b.t, b.dist, count(*)::DOUBLE AS sigma
  FROM best b JOIN walk w ON (w.graph_id, w.s, w.t, w.dist) = (b.graph_id, b.s, b.t, b.dist) GROUP BY ALL)
"""
_DIRECTED = _GRAPH.replace("{edges}", "e")
_UNDIRECTED = _GRAPH.replace("{edges}", "und")

_DEGREE = """
deg AS (SELECT n.graph_id, n.node, CASE WHEN num_nodes <= 1 THEN 1.0 ELSE
    (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id AND e.src = n.node)::DOUBLE / (num_nodes - 1) +
    (SELECT count(*) FROM e WHERE e.graph_id = n.graph_id AND e.dst = n.node)::DOUBLE / (num_nodes - 1) END AS v
  FROM n JOIN sz USING (graph_id))"""
_CLOSE = """
inc AS (SELECT graph_id, t AS node, sum(dist)::DOUBLE AS total, count(*) - 1 AS r FROM paths GROUP BY ALL),
clo AS (SELECT graph_id, node, CASE WHEN total > 0 AND num_nodes > 1 THEN r / total * r / (num_nodes - 1) ELSE 0 END AS v
  FROM inc JOIN sz USING (graph_id))"""
_BETWEEN = """
trip AS (SELECT a.graph_id, a.t AS node, sum(a.sigma * b.sigma / c.sigma) AS raw
  FROM paths a JOIN paths b ON b.graph_id = a.graph_id AND b.s = a.t
  JOIN paths c ON c.graph_id = a.graph_id AND c.s = a.s AND c.t = b.t AND c.dist = a.dist + b.dist
  WHERE a.t <> a.s AND b.t <> a.t AND a.s <> b.t GROUP BY ALL),
bet AS (SELECT n.graph_id, n.node,
    coalesce(raw, 0) * CASE WHEN num_nodes > 2 THEN 1.0::DOUBLE / ((num_nodes - 1) * (num_nodes - 2)) ELSE 1 END AS v
  FROM n JOIN sz USING (graph_id) LEFT JOIN trip USING (graph_id, node))"""
_CLUSTER = """
ud AS (SELECT graph_id, src AS node, count(*) AS d FROM und GROUP BY ALL),
tri AS (SELECT a.graph_id, a.src AS node, count(*) AS t FROM und a JOIN und b ON b.graph_id = a.graph_id AND b.src = a.src
    AND a.dst < b.dst JOIN und c ON c.graph_id = a.graph_id AND c.src = a.dst AND c.dst = b.dst GROUP BY ALL),
clu AS (SELECT n.graph_id, n.node, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS v
  FROM n LEFT JOIN ud USING (graph_id, node) LEFT JOIN tri USING (graph_id, node))"""
_REACH = """
reach AS (SELECT graph_id, s AS node, min(t) AS component FROM best GROUP BY ALL)"""
_BASIC = _REACH + """,
parts AS (SELECT graph_id, count(*) AS num_nodes, count(DISTINCT component) AS parts FROM reach GROUP BY 1),
m AS (SELECT graph_id, count(*) AS num_edges FROM e GROUP BY 1),
basic AS (SELECT graph_id, num_nodes, num_edges,
    CASE WHEN num_nodes > 1 THEN num_edges::DOUBLE / (num_nodes * (num_nodes - 1)) ELSE 0 END AS density, parts = 1 AS is_connected
  FROM parts JOIN m USING (graph_id))"""
_LENGTHS = """
len AS (SELECT graph_id, avg(dist) FILTER (dist > 0) AS mean, max(dist) FILTER (dist > 0) AS longest FROM best GROUP BY 1),
lens AS (SELECT graph_id, CASE WHEN is_connected AND mean IS NOT NULL THEN mean ELSE 0 END AS avg_path_length,
    CASE WHEN is_connected AND mean IS NOT NULL THEN longest ELSE 0 END AS diameter FROM basic LEFT JOIN len USING (graph_id))"""


def _summed(ctes: str, table: str, name: str) -> str:
    return (f"{ctes} SELECT graph_id, round(avg(v), 6) AS avg_{name}, round(max(v), 6)::DOUBLE AS max_{name} "
            f"FROM {table} GROUP BY 1")


def _features_cte() -> str:
    """Directed and undirected walks side by side."""
    directed = _DIRECTED
    second = """,
uwalk AS (
  SELECT graph_id, node AS s, node AS t, 0 AS dist, [node] AS seen FROM n
  UNION ALL
  SELECT w.graph_id, w.s, x.dst, w.dist + 1, list_append(w.seen, x.dst)
  FROM uwalk w JOIN und x ON x.graph_id = w.graph_id AND x.src = w.t WHERE NOT list_contains(w.seen, x.dst)),
ubest AS (SELECT graph_id, s, t, min(dist) AS dist FROM uwalk GROUP BY ALL)"""
    parts = [_DEGREE, _CLOSE, _BETWEEN, _CLUSTER, (_BASIC + "," + _LENGTHS).replace("FROM best", "FROM ubest")]
    return directed + second + "".join("," + p for p in parts)


_SCORED = """
WITH sc AS (SELECT doc_id, quality AS label, round(n_chars / (n_chars + 1500.0::DOUBLE), 1) AS probability
  FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, CASE WHEN probability > 0.5::DOUBLE THEN 1 ELSE 0 END AS prediction FROM sc)
"""


def _weighted(source: str, by: str = "") -> str:
    """Per-class scores of a table (label, prediction) as CTE `cls`."""
    keys = f"{by}," if by else ""
    on = f" AND b.{by} = a.{by}" if by else ""
    return f"""
sup AS (SELECT {keys} label, count(*) AS support, sum((label = prediction)::INT) AS hits FROM {source} GROUP BY ALL),
prd AS (SELECT {keys} prediction AS label, count(*) AS predicted FROM {source} GROUP BY ALL),
cls0 AS (SELECT a.*, coalesce(b.predicted, 0) AS predicted FROM sup a LEFT JOIN prd b ON b.label = a.label{on}),
cls AS (SELECT *, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS pr, hits::DOUBLE / support AS re,
  CASE WHEN hits > 0 THEN 2 * (hits::DOUBLE / predicted) * (hits::DOUBLE / support)
       / (hits::DOUBLE / predicted + hits::DOUBLE / support) ELSE 0 END AS fm FROM cls0)"""


def _auc(source: str, by: str = "") -> str:
    keys = f"{by}," if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
rk AS (SELECT {keys} label, rank() OVER ({part} ORDER BY probability) + (count(*) OVER (PARTITION BY {keys} probability) - 1) / 2.0::DOUBLE AS r
  FROM {source}),
auc AS (SELECT {keys} CASE WHEN min(label) = max(label) THEN 0 ELSE
  (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))::DOUBLE END AS roc_auc
  FROM rk {"GROUP BY " + by if by else ""})"""


_METRIC_COLUMNS = """round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS "precision",
  round(sum(re * support) / sum(support), 6) AS recall, round(sum(fm * support) / sum(support), 6) AS f1"""

_PAIRS = """
WITH pairs AS (SELECT a.conv_id, b.turn, a.text AS generated, b.text AS reference
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')
"""

_BLEU_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]')"
_ROUGE_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def _gram_counts(tokens: str, sizes: tuple) -> str:
    """CTEs with per-pair n-gram hits, generated and reference totals."""
    grams = " UNION ALL ".join(
        f"SELECT conv_id, turn, {n} AS n, '{side}' AS side, array_to_string({tok}[i:i + {n - 1}], ' ') AS gram "
        f"FROM (SELECT conv_id, turn, {tok}, unnest(range(1, len({tok}) - {n - 2})) AS i FROM tok)"
        for n in sizes for side, tok in (("g", "tg"), ("r", "tr")))
    return f"""
tok AS (SELECT conv_id, turn, {tokens.format('generated')} AS tg, {tokens.format('reference')} AS tr FROM pairs),
grams AS ({grams}),
cnt AS (SELECT conv_id, turn, n, gram, count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'r') AS r FROM grams GROUP BY ALL),
hits AS (SELECT conv_id, turn, n, sum(least(g, r))::DOUBLE AS hit, sum(g)::DOUBLE AS gen, sum(r)::DOUBLE AS ref FROM cnt GROUP BY ALL)"""


def _rouge(n: int) -> str:
    return f"""coalesce((SELECT CASE WHEN hit > 0 THEN round(2 * (hit / gen) * (hit / ref) / (hit / gen + hit / ref), 6) ELSE 0 END
    FROM hits h WHERE h.conv_id = pairs.conv_id AND h.turn = pairs.turn AND n = {n}), 0)::DOUBLE"""


_BAGS = """
WITH b AS (SELECT vec_id, label AS bag, embedding, 
  list_sum(list_transform([[0, 1.0], [1, -0.5], [2, 0.75], [3, 0.25]], lambda o: o[2]::DOUBLE * tanh(list_sum(list_transform(
    embedding, lambda x, d: x::DOUBLE * ((o[1]::INT * 7 + (d - 1) * 3) % 5 - 2) / 10.0::DOUBLE))))) AS score FROM embeddings),
t AS (SELECT bag, max(score) AS top FROM b GROUP BY 1),
w AS (SELECT vec_id, b.bag, embedding, exp(score - top) AS e FROM b JOIN t ON t.bag = b.bag),
q AS (SELECT *, e / sum(e) OVER (PARTITION BY bag) AS a FROM w)
"""

_DEP_EDGES = "3 * c0 + c1 + 2 * c2 + 7 * c3 + 2 * c5 + (c5 > 0)::INT"
_DEP_NODES = "c0 + 2 + c2 + (c2 > 0)::INT + c3 + 3 * (c3 > 0)::INT + 2 * (c5 > 0)::INT"
_TOTAL_NODES = "1 + 14 * c0 + 5 * c1 + 7 * c2 + 20 * c3 + 12 * c5 + 2 * im"

# Node types per statement kind: (type, module, c0, c1, c2, c3, c5, import).
_TYPES = [
    ("Module", 1, 0, 0, 0, 0, 0, 0), ("FunctionDef", 0, 1, 0, 0, 0, 1, 0), ("arguments", 0, 1, 0, 0, 0, 1, 0),
    ("arg", 0, 1, 0, 0, 0, 1, 0), ("Assign", 0, 1, 0, 1, 0, 0, 0), ("Name", 0, 3, 1, 2, 7, 2, 0),
    ("Store", 0, 1, 0, 1, 1, 0, 0), ("Load", 0, 2, 1, 1, 6, 2, 0), ("BinOp", 0, 1, 0, 0, 0, 0, 0),
    ("Add", 0, 1, 0, 0, 0, 0, 0), ("Constant", 0, 1, 1, 1, 0, 1, 0), ("Return", 0, 1, 0, 0, 0, 1, 0),
    ("Expr", 0, 0, 1, 0, 1, 1, 0), ("Call", 0, 0, 1, 0, 2, 1, 0), ("If", 0, 0, 0, 1, 1, 0, 0),
    ("For", 0, 0, 0, 0, 1, 0, 0), ("While", 0, 0, 0, 0, 1, 0, 0), ("ClassDef", 0, 0, 0, 0, 0, 1, 0),
    ("ImportFrom", 0, 0, 0, 0, 0, 0, 1), ("alias", 0, 0, 0, 0, 0, 0, 1),
]
_TYPE_VALUES = ", ".join(str(t) for t in _TYPES)
_TYPE_SUM = "m + k0 * c0 + k1 * c1 + k2 * c2 + k3 * c3 + k5 * c5 + ki * im"
_UNIQUE = f"""(SELECT count(*) FROM (VALUES {_TYPE_VALUES}) v(node_type, m, k0, k1, k2, k3, k5, ki) WHERE {_TYPE_SUM} > 0)"""

_LINES = "string_split(text, chr(10))"
_NOT_BLANK = "regexp_matches(x, '[^\\s]')"
_WORD = r"[\p{L}\p{N}_]"
# White space as Python's patterns have it.
_SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _regex_columns(code: str) -> str:
    words = f"regexp_extract_all({code}, '{_WORD}+')"  # whole words, as there is no look-around

    def count(pattern):
        return f"len(regexp_extract_all({code}, '{pattern}'))::BIGINT"

    def counted(test):
        return f"len(list_filter({words}, lambda x: {test}))::BIGINT"

    return f"""list_contains({words}, 'def')::BIGINT AS has_functions, list_contains({words}, 'class')::BIGINT AS has_classes,
      regexp_matches({code}, '(?m)^[{_SPACES}]*(import|from)')::BIGINT AS has_imports,
      {counted("x IN ('if', 'elif')")} AS conditional_statements, {counted("x IN ('for', 'while')")} AS loop_statements,
      {counted("x IN ('try', 'except', 'finally')")} AS exception_handling,
      {count(f"print[{_SPACES}]*" + "[(]")} AS debug_prints, {count('(?i)TODO|FIXME|XXX')} AS todo_comments,
      {counted(f"regexp_full_match(x, '[\\p{{Nd}}]{{2,}}')")} AS magic_numbers"""


# What the snippets of the derived code have, in their order (the sixth parses in a wrapper, the seventh never).
_SNIPPET_STATUS = ["ok", "ok", "ok", "ok", "ok", "wrapped", "syntax", "ok"]
_SNIPPET_LINES = [2, 4, 11, 11, 12, 3, 2, 5]
_SNIPPET_METRICS = {
    "ast_depth": [4, 7, 8, 5, 9, 4, 0, 6], "total_nodes": [9, 25, 38, 44, 42, 12, 0, 19],
    "num_functions": [0, 1, 1, 2, 2, 1, 0, 0], "num_classes": [0, 0, 0, 0, 1, 0, 0, 0],
    "num_imports": [0, 0, 0, 1, 0, 0, 0, 1], "num_loops": [1, 0, 0, 0, 2, 0, 0, 1],
    "num_conditionals": [0, 1, 2, 0, 1, 0, 0, 1], "num_try_blocks": [0, 0, 1, 0, 0, 0, 0, 0],
    "cyclomatic_complexity": [2, 2, 5, 1, 5, 1, 0, 3], "cognitive_complexity": [1, 1, 6, 0, 8, 0, 0, 3],
    "function_calls": [1, 1, 2, 3, 2, 0, 0, 2], "assignments": [0, 0, 3, 3, 1, 2, 0, 0],
    "returns": [0, 2, 1, 2, 1, 0, 0, 0], "exceptions": [0, 0, 1, 0, 0, 0, 0, 0],
    "cfg_nodes": [1, 2, 3, 2, 4, 1, 0, 2], "cfg_edges": [0, 1, 2, 0, 2, 0, 0, 1],
    "cfg_connected_components": [1, 1, 1, 2, 2, 1, 0, 1], "dep_nodes": [2, 2, 7, 7, 7, 3, 0, 2],
    "dep_edges": [0, 2, 9, 12, 9, 3, 0, 0], "function_connectivity": [0, 1, 0, 1, 0, 0, 0, 0],
    "variable_scope_complexity": [0, 1, 3, 4, 5, 2, 0, 0], "call_chain_depth": [1, 1, 2, 1, 1, 0, 0, 1],
    "unique_variables": [0, 0, 1, 3, 1, 2, 0, 0],
}
_SNIPPET_FUNCTIONS = ["", "fact", "f", "one,two", "m,inner", "wrapper", "", ""]
# Control flow: kind of node and its number in the tree, counted from 0 in reading order.
_SNIPPET_FLOW = {1: ["FunctionDef 1>If 4"], 2: ["FunctionDef 1>If 6", "If 6>If 20"],
                 4: ["FunctionDef 2>While 16", "While 16>For 18"], 7: ["While 6>If 9"]}
# Names: a function points at what it stores and calls, what it reads points at the function.
_SNIPPET_NAMES = {
    1: ["n>fact", "fact>fact"],
    2: ["a>f", "f>x", "f>g", "g>f", "f>h", "h>f", "b>f", "ValueError>f", "x>f"],
    3: ["one>q", "p>one", "q>one", "two>r", "two>one", "one>two", "p>two", "two>print", "print>two", "r>two", "two>z", "two>two"],
    4: ["inner>w", "v>inner", "w>inner", "inner>k", "inner>open", "open>inner", "inner>fh", "inner>inner", "k>inner"],
    5: ["wrapper>x", "wrapper>y", "x>wrapper"]}
_SNIPPET_DEFINITIONS = {
    1: ["function:fact>", "calls:fact>fact"], 2: ["function:f>"], 3: ["function:one>", "function:two>", "calls:two>one"],
    4: ["class:A>", "method:A.m>", "function:m>", "function:inner>", "owns:A>A.m"]}


def _snippet_rows(table: dict) -> str:
    rows = [(k, *(e.split(":") if ":" in e else ("", e))) for k, edges in table.items() for e in edges]
    values = ", ".join(f"({k}, '{kind}', '{e.split('>')[0]}', '{e.split('>')[1]}')" for k, kind, e in rows)
    return f"documents JOIN (VALUES {values}) v(k, kind, src, dst) ON doc_id % 8 = k"


def _snippet_metrics() -> str:
    def pick(values):
        return f"[{', '.join(map(repr, values))}][doc_id % 8 + 1]"

    metrics = ", ".join(f"{pick(v)}::BIGINT AS {name}" for name, v in _SNIPPET_METRICS.items())
    return (f"SELECT doc_id, {pick(_SNIPPET_STATUS)} AS status, {pick(_SNIPPET_FUNCTIONS)} AS functions, {metrics}, "
            f"({pick(_SNIPPET_LINES)} + len(string_split(text, chr(10))))::BIGINT AS lines FROM documents")


_LONG_HASH = "md5({0}::VARCHAR) || substr(md5({0}::VARCHAR), 1, 8)"


_WORD_SET = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"


def _jaccard(left: str, right: str) -> str:
    a, b = _WORD_SET.format(left), _WORD_SET.format(right)
    both = f"len(list_intersect({a}, {b}))"
    return (f"round(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END, 6)")


_SPLIT = """WITH r AS (SELECT doc_id, row_number() OVER ({part} ORDER BY md5(doc_id || '-42')) AS rn, count(*) OVER ({part}) AS n FROM labels)"""

# Issue names that become flags.
_FLAGS = ["empty_change", "very_long_change", "long_change", "no_comments", "todo_markers", "debug_prints", "long_lines",
          "deep_nesting", "inconsistent_indentation", "unparseable_syntax"]


def _messages() -> str:
    return """list_filter([
      CASE WHEN list_contains(issues, 'very_long_change') THEN '📏 Consider breaking this large change into smaller, more focused commits' END,
      CASE WHEN list_contains(issues, 'no_comments') THEN '📝 Adding comments would improve code readability and maintainability' END,
      CASE WHEN list_contains(issues, 'todo_markers_detected') THEN '📋 TODO/FIXME comments found. Consider addressing them' END,
      CASE WHEN list_contains(issues, 'debug_prints_detected') THEN '🐛 Remove debug print statements before committing' END,
      CASE WHEN list_contains(issues, 'long_lines') THEN '📐 Some lines exceed recommended length. Consider breaking them up' END,
      CASE WHEN 1 + c2 + 3 * c3 > 10 THEN '🔧 High cyclomatic complexity detected. Consider refactoring into smaller functions' END,
      CASE WHEN c0 + c5 > 5 THEN '🏗️ Multiple functions in one change. Consider separating concerns' END
    ], lambda x: x IS NOT NULL)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt() -> str:
    removed = "array_to_string(list_filter(lines, lambda x, j: j % 2 = 0), chr(10))"
    shown = f"CASE WHEN {removed} = '' THEN {_quoted(NO_REMOVED)} ELSE {removed} END"
    fields = [f"'src/doc_' || doc_id || '.py'", shown, "code", "array_to_string(lines, chr(10))"]
    parts = [_quoted(p) for p in PROMPT.split("%s")]
    return " || ".join(x for pair in zip(parts, [f"({f})" for f in fields] + ["''"]) for x in pair)


_PROMPT = _prompt()


def _template_case(field: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {_quoted(t[field])}" for i, t in enumerate(TEMPLATES))
    return f"CASE doc_id % {len(TEMPLATES)} {cases} END"


_GOOD = "'✅ Code looks good! No significant issues detected'"

ORACLE: dict[str, str] = {
    # patches
    "hunk_parse": _PATCH + """SELECT h.commit_hash, file_path, change_type, hunk_type, hunk_idx::BIGINT AS hunk_idx,
      coalesce(old_start, -1)::BIGINT AS old_start, coalesce(old_count, -1)::BIGINT AS old_count,
      coalesce(new_start, -1)::BIGINT AS new_start, coalesce(new_count, -1)::BIGINT AS new_count,
      (CASE WHEN hunk_type = 'hunk' THEN new_start ELSE 1 END)::BIGINT AS line_start,
      (CASE WHEN hunk_type = 'hunk' THEN new_start + new_count - 1 ELSE 1 END)::BIGINT AS line_end,
      files_changed, total_hunks, commit_size, md5(array_to_string(added, chr(10))) AS added,
      md5(array_to_string(removed, chr(10))) AS removed, md5(array_to_string(context, chr(10))) AS context
      FROM hunks h JOIN ctx USING (commit_hash)""",
    "hunk_parse_two_step": _PATCH + """SELECT h.commit_hash, file_path, hunk_idx::BIGINT AS hunk_idx,
      (CASE WHEN hunk_type = 'hunk' THEN new_count - len(context) ELSE 1 END)::BIGINT AS n_added,
      (CASE WHEN hunk_type = 'hunk' THEN old_count - len(context) ELSE 0 END)::BIGINT AS n_removed, len(context)::BIGINT AS n_context,
      files_changed, total_hunks, (sum(CASE WHEN hunk_type = 'hunk' THEN new_count - len(context) ELSE 1 END)
        OVER (PARTITION BY h.commit_hash))::BIGINT AS commit_size FROM hunks h JOIN ctx USING (commit_hash)""",
    "hunk_commit_join": _PATCH + """SELECT h.commit_hash, file_path, hunk_idx::BIGINT AS hunk_idx, len(added) AS n_added,
      md5(message) AS message, author, date FROM hunks h JOIN commits c USING (commit_hash)""",
    "file_change_types": _PATCH + """SELECT change_type, string_split(file_path, '.')[-1] AS extension, count(*) AS files,
      sum(is_binary)::BIGINT AS binary_files FROM files GROUP BY ALL""",
    "commit_stats": _STATS + """SELECT commit_hash, sum(insertions)::BIGINT AS total_insertions,
      sum(deletions)::BIGINT AS total_deletions, count(DISTINCT file_path) AS files_changed FROM every_file GROUP BY 1""",
    "file_stats": _STATS + "SELECT commit_hash, file_path, change_type, insertions, deletions FROM every_file",
    "recent_commits": _PATCH + f"SELECT {_RECENT} FROM commits WHERE doc_id > 0 AND doc_id % 50 <> 49 ORDER BY doc_id DESC LIMIT 25",
    "commits_touching": _PATCH + f"""SELECT {_RECENT} FROM commits WHERE commit_hash IN
      (SELECT commit_hash FROM files WHERE file_path LIKE '%.md') ORDER BY doc_id DESC LIMIT 40""",
    "commit_sequence": "SELECT md5(doc_id::VARCHAR) AS commit_hash, row_number() OVER (ORDER BY doc_id DESC) - 1 AS seq FROM documents",
    "log_commits": _PATCH + f"""SELECT {_LONG_HASH.format('doc_id')} AS commit_hash,
      CASE WHEN doc_id > 0 THEN {_LONG_HASH.format('(doc_id - 1)')} END AS parent_hash, doc_id % 50 = 49 AS is_merge, author,
      md5(regexp_replace(message, '[{_SPACES}]+$', '')) AS message, own_date AS date FROM commits WHERE doc_id >= 100""",
    "log_patches": _STATS + """SELECT commit_hash || substr(commit_hash, 1, 8) AS commit_hash, sum(insertions)::BIGINT AS total_insertions,
      sum(deletions)::BIGINT AS total_deletions, count(DISTINCT file_path) AS files_changed FROM every_file
      WHERE commit_hash NOT IN (SELECT md5(doc_id::VARCHAR) FROM documents WHERE doc_id % 50 = 49) GROUP BY ALL""",
    "text_file_types": _STATS + """SELECT change_type, string_split(file_path, '.')[-1] AS extension, count(*) AS files FROM files
      WHERE is_binary = 0 GROUP BY ALL""",
    "staged_diffs": _STATS + """SELECT substr(commit_hash, 1, 12) AS commit_hash, sum(insertions)::BIGINT AS total_insertions,
      sum(deletions)::BIGINT AS total_deletions, count(DISTINCT file_path) AS files_changed FROM every_file GROUP BY 1""",
    "comment_file": """SELECT doc_id::VARCHAR AS commit_hash, 'a,' || source AS file_path, (doc_id % 100)::BIGINT AS line_number,
      md5(text) AS comment, (doc_id % 8) / 8.0::DOUBLE AS quality_score FROM documents""",
    "comment_sink": """SELECT source AS file_path, length(text)::BIGINT AS line_number, md5(text) AS comment,
      CASE WHEN length(text) % 2 = 0 THEN doc_id::VARCHAR ELSE 'current' END AS commit_hash FROM documents""",
    "result_sinks": """SELECT 'results' AS sink, quality::VARCHAR AS key, count(*)::DOUBLE AS value FROM labels GROUP BY quality
      UNION ALL SELECT 'attention', doc_id || ':' || source, (doc_id % 16) / 16.0::DOUBLE FROM documents""",
    "snippet_metrics": _snippet_metrics(),
    "snippet_flow": f"SELECT doc_id, src, dst FROM {_snippet_rows(_SNIPPET_FLOW)}",
    "snippet_dependencies": f"SELECT doc_id, src, dst FROM {_snippet_rows(_SNIPPET_NAMES)}",
    "snippet_definitions": f"SELECT doc_id, kind, src, dst FROM {_snippet_rows(_SNIPPET_DEFINITIONS)}",
    "model_round_trip": _SPLIT.replace("{part}", "PARTITION BY quality") + """ SELECT doc_id, unnest(['logistic', 'random_forest']) AS model,
      true AS same, true AS consistent FROM r WHERE rn <= ceil(0.2 * n)""",
    "shap_forest": "SELECT doc_id, true AS adds_up, true AS bounded FROM labels JOIN documents USING (doc_id)",
    "graph_defaults": _UNDIRECTED + "," + _BASIC + "," + _LENGTHS + """SELECT b.graph_id, b.num_nodes, b.num_edges, b.is_connected,
      round(avg_path_length, 6)::DOUBLE AS avg_path_length, diameter::BIGINT AS diameter FROM basic b JOIN lens USING (graph_id)
      UNION ALL SELECT DISTINCT user_id::VARCHAR || '-none', 0, 0, false, 0, 0 FROM events""",
    "snapshot_diff": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'D' END AS change_type,
      (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END)::BIGINT AS old_count,
      (CASE WHEN doc_id % 2 = 0 THEN len(string_split(text, chr(10))) ELSE 0 END)::BIGINT AS new_count,
      md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END) AS added, md5(CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END) AS removed
      FROM documents""",
    "full_file_hunks": """WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a FROM documents),
      k AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM l)
      SELECT 'doc_' || doc_id AS file_path, 'full_file' AS hunk_type, len(a)::BIGINT AS line_end, len(a)::BIGINT AS n_added,
      md5(array_to_string(a, chr(10))) AS added FROM k""",
    "version_diff": """WITH v AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old
        FROM conversations WHERE role = 'assistant'),
      n AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (text LIKE '%' || chr(10))::INT END AS here,
        CASE WHEN coalesce(old, '') = '' THEN 0 ELSE len(string_split(old, chr(10))) - (old LIKE '%' || chr(10))::INT END AS there FROM v)
      SELECT conv_id, turn, CASE WHEN old IS NULL THEN 'A' WHEN old <> text THEN 'M' END AS change_type, sha256(text) AS forward,
        sha256(coalesce(old, '')) AS backward, (here - there)::BIGINT AS grown FROM n""",
    "file_asof": """SELECT conv_id::VARCHAR AS file_path, turn AS seq, md5(coalesce((SELECT arg_min(s.text, s.turn) FROM conversations s
      WHERE s.conv_id = r.conv_id AND s.role = 'assistant' AND s.turn >= r.turn), '')) AS content
      FROM conversations r WHERE role <> 'assistant'""",
    # lines
    "line_metrics": f"""SELECT doc_id, len(list_filter({_LINES}, lambda x: {_NOT_BLANK}))::BIGINT AS lines_of_code, len({_LINES})::BIGINT AS total_lines,
      len(list_filter({_LINES}, lambda x: regexp_matches(x, '^\\s*#')))::BIGINT AS comment_lines,
      len(list_filter({_LINES}, lambda x: NOT {_NOT_BLANK}))::BIGINT AS blank_lines,
      list_max(list_transform({_LINES}, lambda x: length(x)))::BIGINT AS max_line_length,
      round(list_sum(list_transform({_LINES}, lambda x: length(x)))::DOUBLE / len({_LINES}), 6) AS avg_line_length FROM documents""",
    "regex_features": f"SELECT doc_id, {_regex_columns('text')} FROM documents",
    "code_regex_features": _CODE + f"SELECT doc_id, {_regex_columns('code')} FROM kinds",
    "indent_features": f"""WITH i AS (SELECT doc_id, list_transform(list_filter(list_transform({_LINES}, lambda x, j:
        repeat(' ', ((j - 1) % 7)::INT) || x), lambda x: {_NOT_BLANK}),
        lambda x: length(x) - length(regexp_replace(x, '^\\s+', ''))) AS a FROM documents)
      SELECT doc_id, coalesce(list_max(a), 0)::BIGINT AS max_indentation, len(list_distinct(a))::BIGINT AS indent_variance,
      round(coalesce(list_sum(a)::DOUBLE / len(a), 0), 6) AS avg_indentation FROM i""",
    "volume_features": _CODE + f"""SELECT doc_id, len(list_filter(added, lambda x: {_NOT_BLANK}))::BIGINT AS lines_added,
      length(code)::BIGINT AS total_chars, (len(lines) // 2)::BIGINT AS lines_removed,
      list_max(list_transform(added, lambda x: length(x)))::BIGINT AS max_line_length,
      round(len(list_filter(added, lambda x: regexp_matches(x, '^\\s*#')))::DOUBLE / len(added), 6) AS comment_density,
      round(list_sum(list_transform(added, lambda x: length(x)))::DOUBLE / len(added), 6) AS avg_line_length FROM kinds""",
    "clean_code": f"""WITH t AS (SELECT doc_id, array_to_string(list_transform({_LINES}, lambda x, j: '  ' || replace(x, '#', '') ||
        CASE (j - 1) % 3 WHEN 0 THEN ' # note' WHEN 1 THEN chr(10) || ' ' || chr(10)
        ELSE chr(10) || '\"\"\"' || chr(10) || 'block' || chr(10) || '\"\"\"' END), chr(10)) AS code FROM documents)
      SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code,
        '\\n\\s*\\n', chr(10), 'g'), '#.*', '', 'g'), '(?s)\"\"\".*?\"\"\"', '', 'g'), '(?s)''''''.*?''''''', '', 'g'),
        '^\\s+|\\s+$', '', 'g')) AS cleaned FROM t""",
    "token_count": f"SELECT doc_id, len(regexp_extract_all(text, '{_WORD}+|[^\\p{{L}}\\p{{N}}_{_SPACES}]'))::BIGINT AS tokens FROM documents",
    "code_preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents",
    "context_similarity": _PAIRS + f"SELECT conv_id, turn, {_jaccard('generated', 'reference')} AS similarity FROM pairs",
    # syntax
    "ast_metrics": _CODE + f"""SELECT doc_id, (CASE WHEN c3 > 0 THEN 8 ELSE 5 END)::BIGINT AS ast_depth, ({_TOTAL_NODES})::BIGINT AS total_nodes,
      (c0 + c5)::BIGINT AS num_functions, c5::BIGINT AS num_classes, im::BIGINT AS num_imports, (2 * c3)::BIGINT AS num_loops,
      (c2 + c3)::BIGINT AS num_conditionals, 0::BIGINT AS num_try_blocks, (1 + c2 + 3 * c3)::BIGINT AS cyclomatic_complexity,
      (c2 + 6 * c3)::BIGINT AS cognitive_complexity, (c1 + 2 * c3 + c5)::BIGINT AS function_calls, (c0 + c2)::BIGINT AS assignments,
      (c0 + c5)::BIGINT AS returns, 0::BIGINT AS exceptions, (1 + (c2 > 0)::INT)::BIGINT AS unique_variables FROM kinds""",
    "ast_node_counts": _CODE + f"""SELECT doc_id, node_type, ({_TYPE_SUM})::BIGINT AS n FROM kinds
      JOIN (VALUES {_TYPE_VALUES}) v(node_type, m, k0, k1, k2, k3, k5, ki) ON {_TYPE_SUM} > 0""",
    "code_metrics": _CODE + f"""SELECT doc_id, len(list_filter(added, lambda x: {_NOT_BLANK}))::BIGINT AS lines_of_code, len(added)::BIGINT AS total_lines,
      len(list_filter(added, lambda x: regexp_matches(x, '^\\s*#')))::BIGINT AS comment_lines,
      len(list_filter(added, lambda x: NOT {_NOT_BLANK}))::BIGINT AS blank_lines,
      list_max(list_transform(added, lambda x: length(x)))::BIGINT AS max_line_length,
      round(list_sum(list_transform(added, lambda x: length(x)))::DOUBLE / len(added), 6) AS avg_line_length,
      (c0 + c5)::BIGINT AS num_functions, c5::BIGINT AS num_classes, im::BIGINT AS num_imports,
      (1 + (c5 > 0)::INT)::BIGINT AS max_nesting_depth FROM kinds""",
    "cfg_metrics": _CODE + """, g AS (SELECT doc_id, c0 + c5 + c2 + 3 * c3 AS n, 2 * c3 AS m FROM kinds)
      SELECT doc_id, n::BIGINT AS cfg_nodes, m::BIGINT AS cfg_edges, (n - m)::BIGINT AS cfg_connected_components,
      round(CASE WHEN n > 1 THEN m::DOUBLE / (n * (n - 1)) ELSE 0 END, 6) AS cfg_density FROM g""",
    "dep_metrics": _CODE + f""", g AS (SELECT *, {_DEP_NODES} AS n, {_DEP_EDGES} AS m FROM kinds)
      SELECT doc_id, n::BIGINT AS dep_nodes, m::BIGINT AS dep_edges, c5::BIGINT AS function_connectivity,
      (2 * c0 + c5)::BIGINT AS variable_scope_complexity, (CASE WHEN c3 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END)::BIGINT AS call_chain_depth,
      round(m::DOUBLE / (n * (n - 1)), 6) AS dep_density FROM g""",
    "dep_edge_rows": _CODE + f"SELECT doc_id, ({_DEP_EDGES})::BIGINT AS edges FROM kinds",
    "cfg_edge_rows": _CODE + "SELECT doc_id, (2 * c3)::BIGINT AS edges FROM kinds WHERE c3 > 0",
    "definition_graph": _CODE + """, p AS (SELECT doc_id, unnest([{'part': 'node function', 'n': c0 + (c5 > 0)::INT}, {'part': 'node class', 'n': c5},
      {'part': 'node method', 'n': c5}, {'part': 'edge owns', 'n': c5}, {'part': 'edge calls', 'n': c5}]) AS u FROM kinds)
      SELECT doc_id, u.part AS part, u.n::BIGINT AS n FROM p WHERE u.n > 0""",
    # labels
    "quality_label": _LABEL + """SELECT doc_id, round(score, 6) AS quality_score, score > 0.45::DOUBLE AS is_high_quality,
      coalesce(array_to_string(issues, ','), '') AS issues FROM labels_of""",
    "label_report": _LABEL + """SELECT lang, count(*) AS total_samples, sum((score > 0.45::DOUBLE)::INT)::BIGINT AS positive_samples, round(avg(score), 6) AS mean,
      round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max, round(quantile_cont(score, 0.5), 6) AS median,
      0.45::DOUBLE AS current_threshold, round(avg((score > 0.45::DOUBLE)::INT), 6) AS positive_ratio,
      round(quantile_cont(score, 0.7), 6) AS recommended_threshold FROM labels_of GROUP BY 1""",
    "issue_top5": _LABEL + "SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM labels_of) GROUP BY 1 ORDER BY n DESC, issue LIMIT 5",
    "issue_flags": _LABEL + "SELECT doc_id, " + ", ".join(
        f"(list_contains(issues, '{n}') OR list_contains(issues, '{n}_detected'))::BIGINT AS has_{n}" for n in _FLAGS) + " FROM labels_of",
    "positive_share": _LABEL + "SELECT round(avg((score > 0.45::DOUBLE)::INT), 6) AS positive_share FROM labels_of",
    "hunk_features": _LABEL + f"""SELECT doc_id, cnt::BIGINT AS lines_added, (len(lines) // 2)::BIGINT AS lines_removed,
      regexp_matches(code, '\\bdef\\b')::BIGINT AS has_functions, len(regexp_extract_all(code, '\\b(for|while)\\b'))::BIGINT AS loop_statements,
      list_max(list_transform(list_filter(added, lambda x: {_NOT_BLANK}), lambda x: length(x) - length(ltrim(x))))::BIGINT AS max_indentation,
      (CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 1 ELSE 0 END)::BIGINT AS nesting_depth, 1::BIGINT AS ast_parseable,
      {_UNIQUE}::BIGINT AS unique_ast_nodes, ({_TOTAL_NODES})::BIGINT AS total_ast_nodes, 1::BIGINT AS files_changed, 1::BIGINT AS total_hunks,
      cnt::BIGINT AS commit_size, {_jaccard("code", "array_to_string(lines, chr(10))")} AS context_similarity,
      round(comments::DOUBLE / len(added), 6) AS comment_density,
      round(list_avg(list_transform(list_filter(added, lambda x: {_NOT_BLANK}), lambda x: length(x) - length(ltrim(x)))), 6) AS avg_indentation
      FROM labels_of""",
    "feature_vector": """SELECT doc_id, n_chars::DOUBLE AS chars, (CASE WHEN doc_id % 2 = 0 THEN n_chars * 2 ELSE 0 END)::DOUBLE AS even,
      (CASE WHEN doc_id % 3 = 0 THEN n_chars * 3 ELSE 0 END)::DOUBLE AS third FROM documents""",
    "feature_flatten": """SELECT doc_id, n_chars::DOUBLE AS size_chars, (n_chars > 500)::INT::DOUBLE AS size_long,
      (CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END)::DOUBLE AS info_even, 0::DOUBLE AS info_lang FROM documents""",
    "feature_merge": "SELECT doc_id, n_chars::DOUBLE AS a, (n_chars + 1)::DOUBLE AS b, (n_chars + 2)::DOUBLE AS c FROM documents",
    "labelled_features": _LABEL + f""", tokens AS (SELECT *, len(regexp_extract_all(regexp_replace(code, '#.*', '', 'g'), '\\w+|[^\\s\\w]')) AS tok FROM labels_of)
      SELECT lang, count(*) AS samples, sum({_TOTAL_NODES})::BIGINT AS total_nodes, sum({_DEP_EDGES})::BIGINT AS dep_edges, sum(cnt)::BIGINT AS lines_added,
      sum((p_todo > 0)::INT)::BIGINT AS has_todo_markers, sum(tok)::BIGINT AS tokenized_length,
      sum(3 * c0 + c1 + 2 * c2 + 7 * c3 + 2 * c5)::BIGINT AS ast_name_count FROM tokens GROUP BY 1""",
    # graphs
    "graph_basic": _UNDIRECTED + "," + _BASIC + "SELECT graph_id, num_nodes, num_edges, round(density, 6) AS density, is_connected FROM basic",
    "graph_components": _UNDIRECTED + "," + _REACH + "SELECT graph_id, node, component FROM reach",
    "graph_degree": _summed(_DIRECTED + "," + _DEGREE, "deg", "degree_centrality"),
    "graph_closeness": _summed(_DIRECTED + "," + _CLOSE, "clo", "closeness"),
    "graph_betweenness": _summed(_DIRECTED + "," + _BETWEEN, "bet", "betweenness"),
    "graph_clustering": _summed(_DIRECTED + "," + _CLUSTER, "clu", "clustering"),
    "graph_paths": _UNDIRECTED + "," + _BASIC + "," + _LENGTHS +
    "SELECT graph_id, round(avg_path_length, 6)::DOUBLE AS avg_path_length, diameter::BIGINT AS diameter FROM lens",
    "graph_features": _features_cte() + """
      SELECT graph_id, num_nodes::DOUBLE AS basic_metrics_num_nodes, num_edges::DOUBLE AS basic_metrics_num_edges,
        round(density, 6) AS basic_metrics_density, is_connected::INT::DOUBLE AS basic_metrics_is_connected,
        (SELECT round(avg(v), 6) FROM deg WHERE deg.graph_id = b.graph_id) AS centrality_measures_avg_degree_centrality,
        (SELECT round(max(v), 6) FROM deg WHERE deg.graph_id = b.graph_id)::DOUBLE AS centrality_measures_max_degree_centrality,
        (SELECT round(avg(v), 6) FROM bet WHERE bet.graph_id = b.graph_id) AS centrality_measures_avg_betweenness_centrality,
        (SELECT round(max(v), 6) FROM bet WHERE bet.graph_id = b.graph_id)::DOUBLE AS centrality_measures_max_betweenness_centrality,
        (SELECT round(avg(v), 6) FROM clo WHERE clo.graph_id = b.graph_id) AS centrality_measures_avg_closeness_centrality,
        (SELECT round(max(v), 6) FROM clo WHERE clo.graph_id = b.graph_id)::DOUBLE AS centrality_measures_max_closeness_centrality,
        (SELECT round(avg(v), 6) FROM clu WHERE clu.graph_id = b.graph_id) AS structural_metrics_avg_clustering_coefficient,
        (SELECT round(max(v), 6) FROM clu WHERE clu.graph_id = b.graph_id)::DOUBLE AS structural_metrics_max_clustering_coefficient,
        (SELECT round(avg_path_length, 6) FROM lens WHERE lens.graph_id = b.graph_id)::DOUBLE AS structural_metrics_avg_path_length,
        (SELECT diameter FROM lens WHERE lens.graph_id = b.graph_id)::DOUBLE AS structural_metrics_diameter
      FROM basic b""",
    # evaluation
    "class_distribution": """SELECT quality::BIGINT AS label, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total, count(*) OVER () >= 2 AS has_both
      FROM labels GROUP BY quality""",
    "class_weights": """SELECT quality::BIGINT AS label, round((sum(count(*)) OVER ())::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight
      FROM labels GROUP BY quality""",
    "majority_prediction": """SELECT doc_id, (SELECT quality FROM labels GROUP BY 1 ORDER BY count(*) DESC, quality LIMIT 1)::BIGINT AS prediction FROM labels""",
    "stratified_split": _SPLIT.replace("{part}", "PARTITION BY quality") +
    " SELECT doc_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r",
    "three_way_split": _SPLIT.replace("{part}", "") +
    " SELECT doc_id, CASE WHEN rn <= ceil(0.1 * n) THEN 'test' WHEN rn <= ceil(0.2 * n) THEN 'validation' ELSE 'train' END AS split FROM r",
    "hash_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id || '-42') LIMIT 100",
    "oversample": """WITH g AS (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality = 1)
      SELECT 1::BIGINT AS label, n, n AS n_keys, (SELECT sum(doc_id)::BIGINT FROM labels JOIN documents USING (doc_id) WHERE quality = 1)
        AS sum_of_kept_keys, 1::DOUBLE AS constant_feature FROM g UNION ALL SELECT 0, greatest(10, n // 4), greatest(10, n // 4), 0, 1 FROM g""",
    "cls_metrics": _SCORED + "," + _weighted("p") + "," + _auc("p") +
    f" SELECT {_METRIC_COLUMNS}, round(min(roc_auc), 6) AS roc_auc FROM cls, auc",
    "model_comparison": _SCORED + """, mm AS (
        SELECT 'score' AS model, label, probability, prediction FROM p
        UNION ALL SELECT 'opposite', label, 1 - probability, (1 - probability > 0.5::DOUBLE)::INT FROM p
        UNION ALL SELECT 'constant', label, probability, prediction FROM p),""" + _weighted("mm", "model") + "," + _auc("mm", "model") +
    f" SELECT model, {_METRIC_COLUMNS}, round(min(roc_auc), 6) AS roc_auc FROM cls JOIN auc USING (model) GROUP BY model",
    "cls_report": _SCORED + "," + _weighted("p") + """
      SELECT label::VARCHAR AS name, round(pr, 6) AS "precision", round(re, 6) AS recall, round(fm, 6) AS f1, support::BIGINT AS support FROM cls
      UNION ALL SELECT 'accuracy', round(sum(hits)::DOUBLE / sum(support), 6), round(sum(hits)::DOUBLE / sum(support), 6),
        round(sum(hits)::DOUBLE / sum(support), 6), sum(support)::BIGINT FROM cls
      UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(fm), 6), sum(support)::BIGINT FROM cls
      UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
        round(sum(fm * support) / sum(support), 6), sum(support)::BIGINT FROM cls""",
    "confusion": _SCORED + " SELECT label::BIGINT AS label, prediction::BIGINT AS prediction, count(*) AS n FROM p GROUP BY ALL",
    "roc_auc": """WITH s AS (SELECT lang, quality AS label, n_chars % 997 / 997.0::DOUBLE AS probability FROM labels JOIN documents USING (doc_id)),"""
    + _auc("s", "lang") + " SELECT lang, round(roc_auc, 6) AS roc_auc FROM auc",
    "bleu": _PAIRS + "," + _gram_counts(_BLEU_TOKENS, (1, 2, 3, 4)) + """,
      wide AS (SELECT conv_id, turn, max(hit) FILTER (n = 1) AS h1, max(gen) FILTER (n = 1) AS lg, max(ref) FILTER (n = 1) AS lr,
        sum(0.25::DOUBLE * ln(CASE WHEN hit > 0 THEN hit / gen ELSE 2.2250738585072014e-308::DOUBLE END))
          + 0.25::DOUBLE * (4 - count(*)) * ln(2.2250738585072014e-308::DOUBLE) AS logs FROM hits GROUP BY ALL)
      SELECT conv_id, turn, round(coalesce((SELECT CASE WHEN h1 > 0 THEN (CASE WHEN lg > lr THEN 1 ELSE exp(1 - lr / lg) END) * exp(logs) ELSE 0 END
        FROM wide w WHERE w.conv_id = pairs.conv_id AND w.turn = pairs.turn), 0), 6)::DOUBLE AS bleu FROM pairs""",
    "rouge12": _PAIRS + "," + _gram_counts(_ROUGE_TOKENS, (1, 2)) + f" SELECT conv_id, turn, {_rouge(1)} AS rouge1, {_rouge(2)} AS rouge2 FROM pairs",
    # pooling
    "mil_attention": _BAGS + "SELECT vec_id, bag::BIGINT AS bag, round(a, 6) AS attention_weight FROM q",
    "mil_predict": _BAGS + """, u AS (SELECT bag, a, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM q),
      v AS (SELECT bag, d, sum(a * x) AS y FROM u GROUP BY ALL),
      r AS (SELECT bag, h, greatest(0, sum(y * ((h * 5 + d * 2) % 7 - 3) / 10.0::DOUBLE) + any_value([0.0, 0.1, -0.1][h + 1]::DOUBLE)) AS z
        FROM v, (SELECT unnest([0, 1, 2]) AS h) GROUP BY bag, h)
      SELECT bag::BIGINT AS bag, round(1 / (1 + exp(-(sum(z * [0.8, -0.6, 0.4][h + 1]::DOUBLE) + 0.1::DOUBLE))), 5) AS probability
      FROM r GROUP BY bag""",
    "mil_pool": _BAGS + """, u AS (SELECT bag, a, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM q)
      SELECT bag::BIGINT AS bag, count(*) AS instances, dim::BIGINT AS dim, round(sum(a * x::DOUBLE), 5) AS value FROM u GROUP BY bag, dim""",
    "attention_report": _PATCH + """, w AS (SELECT *, exp(len(added) / 10.0::DOUBLE - max(len(added) / 10.0::DOUBLE) OVER (PARTITION BY commit_hash)) AS e FROM hunks)
      SELECT commit_hash, file_path, hunk_idx::BIGINT AS hunk_idx, len(added)::BIGINT AS lines_added, len(removed)::BIGINT AS lines_removed,
      round(e / sum(e) OVER (PARTITION BY commit_hash), 6) AS attention_weight FROM w""",
    "score_batches": """SELECT vec_id, round(1 / (1 + exp(-list_avg(list_transform(embedding, lambda x: x::DOUBLE)))), 6) AS quality_score FROM embeddings""",
    # review
    "review_comments": _LABEL + f""", c AS (SELECT l.doc_id, (n_chars % 101) / 100.0::DOUBLE AS p, {_messages()} AS local FROM labels_of l JOIN documents USING (doc_id)),
      m AS (SELECT doc_id, list_concat(list_filter([
        CASE WHEN p <= 0.5::DOUBLE AND 1 - p > 0.7::DOUBLE THEN printf('⚠️ Random_Forest model flags this code as potentially problematic (confidence: %.2f)', 1 - p) END,
        CASE WHEN p < 0.6::DOUBLE THEN printf('🤖 CodeBERT analysis suggests code quality concerns (score: %.2f)', p)
             WHEN p > 0.8::DOUBLE THEN printf('✅ CodeBERT analysis indicates good code quality (score: %.2f)', p) END],
        lambda x: x IS NOT NULL), local) AS comments FROM c)
      SELECT doc_id, array_to_string(CASE WHEN len(comments) = 0 THEN [{_GOOD}] ELSE comments END, '|') AS comments FROM m""",
    "combined_feedback": _LABEL + f""", c AS (SELECT *, {_messages()} AS local FROM labels_of),
      f AS (SELECT doc_id, list_concat(
        [CASE WHEN len(lines) >= 2 AND array_to_string(list_filter(lines, lambda x, j: j % 2 = 0), chr(10)) <> '' THEN 'Modified '
              || (len(lines) // 2 - (lines[(len(lines) // 2) * 2] = '')::INT) || ' -> ' || (len(added) - (added[-1] = '')::INT) || ' lines'
              ELSE 'Added ' || (len(added) - (added[-1] = '')::INT) || ' new lines' END],
        CASE WHEN len(local) = 0 THEN [{_GOOD}] ELSE local END,
        CASE WHEN doc_id % 3 = 0 THEN ['AI Assessment: doc ' || doc_id, 'Potential Issues: none'] ELSE [] END,
        list_filter([CASE WHEN len(added) > 20 THEN 'Large change detected - consider breaking into smaller commits' END,
          CASE WHEN contains(code, 'TODO') OR contains(code, 'FIXME') THEN 'Contains TODO/FIXME - ensure these are addressed' END,
          CASE WHEN contains(code, 'print(') OR contains(code, 'console.log') THEN 'Debug statements detected - remove before production' END],
          lambda x: x IS NOT NULL)) AS feedback FROM c)
      SELECT doc_id, array_to_string(feedback, '|') AS feedback FROM f""",
    "review_rows": _LABEL + f""", c AS (SELECT *, {_messages()} AS local FROM labels_of),
      f AS (SELECT doc_id, list_concat(
        ['Added ' || (len(added) - (added[-1] = '')::INT) || ' new lines'],
        CASE WHEN len(local) = 0 THEN [{_GOOD}] ELSE local END,
        list_filter([CASE WHEN len(added) > 20 THEN 'Large change detected - consider breaking into smaller commits' END,
          CASE WHEN contains(code, 'TODO') OR contains(code, 'FIXME') THEN 'Contains TODO/FIXME - ensure these are addressed' END,
          CASE WHEN contains(code, 'print(') OR contains(code, 'console.log') THEN 'Debug statements detected - remove before production' END],
          lambda x: x IS NOT NULL)) AS feedback FROM c)
      SELECT md5(doc_id::VARCHAR) AS commit_hash, 'src/doc_' || doc_id || '.py' AS file_path, 1::BIGINT AS line_number,
      (generate_subscripts(feedback, 1) - 1)::BIGINT AS comment_idx, unnest(feedback) AS comment FROM f""",
    "review_prompt": _CODE + f"SELECT doc_id, md5({_PROMPT}) AS prompt FROM kinds",
    "external_review": _CODE + f"SELECT doc_id, length({_PROMPT}) || ' characters' AS assessment FROM kinds",
    "external_parse": """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'a' || doc_id END AS assessment, CASE WHEN doc_id % 4 < 2 THEN 'i' END AS issues,
      CASE WHEN doc_id % 4 = 2 THEN 'plain ' || doc_id END AS analysis, CASE WHEN doc_id % 4 = 3 THEN 'down' END AS error FROM documents""",
    "explain_samples": _LABEL + """, avgs AS (SELECT unnest([{'f': 'num_functions', 'v': avg(c0 + c5)}, {'f': 'num_classes', 'v': avg(c5)}, {'f': 'num_loops', 'v': avg(2 * c3)},
        {'f': 'returns', 'v': avg(c0 + c5)}, {'f': 'assignments', 'v': avg(c0 + c2)}, {'f': 'function_calls', 'v': avg(c1 + 2 * c3 + c5)}]) AS u FROM labels_of),
      top AS (SELECT list(f ORDER BY v DESC, f) AS names FROM (SELECT u.f AS f, u.v AS v FROM avgs ORDER BY v DESC, f LIMIT 5)),
      vals AS (SELECT *, map {'num_functions': c0 + c5, 'num_classes': c5, 'num_loops': 2 * c3, 'returns': c0 + c5, 'assignments': c0 + c2,
        'function_calls': c1 + 2 * c3 + c5} AS v FROM labels_of)
      SELECT doc_id, CASE WHEN length(code) > 200 THEN substr(code, 1, 200) || '...' ELSE code END AS code_snippet,
      score > 0.45::DOUBLE AS predicted_quality, coalesce(array_to_string(issues, ','), '') AS issues,
      array_to_string(list_transform(names, lambda n: n || '=' || v[n]), ',') AS top FROM vals, top""",
    "synthetic_commits": f"""WITH t AS (SELECT doc_id, replace({_template_case(1)}, 'user', 'user_' || doc_id) AS code, {_template_case(0)} AS quality FROM documents)
      SELECT 'synthetic_' || doc_id AS commit_hash, 'Synthetic ' || quality || ' quality commit' AS message,
      len(string_split(code, chr(10)))::BIGINT AS line_end, md5(code) AS added FROM t""",
}

_EXACT_BLEU = ORACLE["bleu"].replace("round(coalesce((SELECT", "(coalesce((SELECT").replace(", 0), 6)::DOUBLE AS bleu", ", 0))::DOUBLE AS bleu")
_EXACT_ROUGE = ORACLE["rouge12"].replace("THEN round(2 *", "THEN (2 *").replace("(hit / gen + hit / ref), 6)", "(hit / gen + hit / ref))")
ORACLE["evaluate_tasks"] = _SCORED + """, mm AS (
        SELECT 'quality' AS task, label, probability, prediction FROM p
        UNION ALL SELECT 'classification', label, 1 - probability, 1 - prediction FROM p),""" + _weighted("mm", "task") + "," + _auc(
    "mm", "task") + f""", wide AS (SELECT task, {_METRIC_COLUMNS}, round(min(roc_auc), 6) AS roc_auc
      FROM cls JOIN auc USING (task) GROUP BY task)
      SELECT task, metric, value FROM (UNPIVOT wide ON accuracy, "precision", recall, f1, roc_auc INTO NAME metric VALUE value)
      UNION ALL SELECT 'comment', 'bleu', round(avg(bleu), 6) FROM ({_EXACT_BLEU})
      UNION ALL SELECT 'comment', 'rouge1', round(avg(rouge1), 6) FROM ({_EXACT_ROUGE})
      UNION ALL SELECT 'comment', 'rouge2', round(avg(rouge2), 6) FROM ({_EXACT_ROUGE})"""

# Features of whole documents, by the statement that has each.
_FEATURES_OF = {
    "ast_metrics": ["ast_depth", "total_nodes", "num_functions", "num_classes", "num_imports", "num_loops", "num_conditionals",
                    "num_try_blocks", "cyclomatic_complexity", "cognitive_complexity", "function_calls", "assignments", "returns",
                    "exceptions", "unique_variables"],
    "cfg_metrics": ["cfg_nodes", "cfg_edges", "cfg_connected_components", "cfg_density"],
    "dep_metrics": ["dep_nodes", "dep_edges", "function_connectivity", "variable_scope_complexity", "call_chain_depth", "dep_density"],
    "code_regex_features": ["has_functions", "has_classes", "has_imports", "conditional_statements", "loop_statements",
                            "exception_handling", "debug_prints", "todo_comments", "magic_numbers"],
    "hunk_features": ["lines_added", "lines_removed", "max_indentation", "nesting_depth", "ast_parseable", "unique_ast_nodes",
                      "total_ast_nodes", "files_changed", "total_hunks", "commit_size", "context_similarity", "comment_density",
                      "avg_indentation"],
    "issue_flags": [f"has_{n}" for n in _FLAGS],
}
_NODE_FEATURES = [f"ast_{t[0].lower()}_count" for t in _TYPES]
FEATURE_NAMES = [n for names in _FEATURES_OF.values() for n in names] + _NODE_FEATURES


def _feature_rows() -> str:
    parts = " JOIN ".join(f"({ORACLE[name]}) {name}" + (" USING (doc_id)" if i else "") for i, name in enumerate(_FEATURES_OF))
    columns = ", ".join(f"round({table}.{n}::DOUBLE, 6) AS {n}" for table, names in _FEATURES_OF.items() for n in names)
    counts = ", ".join(f"max(CASE WHEN node_type = '{t[0]}' THEN n ELSE 0 END)::DOUBLE AS ast_{t[0].lower()}_count" for t in _TYPES)
    nodes = f"(SELECT doc_id, {counts} FROM ({ORACLE['ast_node_counts']}) GROUP BY doc_id) node_counts"
    return f"SELECT doc_id, {columns}, {', '.join(_NODE_FEATURES)} FROM {parts} JOIN {nodes} USING (doc_id)"


ORACLE["feature_rows"] = _feature_rows()
