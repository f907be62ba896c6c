"""Parse step: Python code to syntax-node rows. The only Python code on the feature path.

An Arrow UDF parses each distinct snippet of a batch once and returns, per snippet, a status and an array of node
structs in pre-order. It records what only a walk over the tree can know (depths, enclosing scope, the function last
entered); every metric is a Spark expression over the nodes.
"""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MODES = ("extractor", "label", "raw")

# name: FunctionDef/ClassDef name, Name id, argument name, or the called name of a Call.
# ctl_depth / call_depth / def_depth: enclosing control statements / calls / definitions.
# scope_fn: node_id of the enclosing function for a local name (stored Name or plain argument), else -1.
# last_fn: function most recently entered; open_fn: the same, but cleared whenever a function ends.
# known: a Call of a function defined at an earlier position. owner: class of a directly contained method.
# cfg_parent: enclosing control-flow node (-1 at top level), null for nodes outside the control-flow graph.
NODE_DDL = (
    "array<struct<node_id:int,parent_id:int,depth:int,field:string,node_type:string,name:string,ctx:string,"
    "ctl_depth:int,call_depth:int,def_depth:int,scope_fn:int,last_fn:string,open_fn:string,known:boolean,"
    "owner:string,cfg_parent:int,is_docstr:boolean>>"
)
CHUNK_ROWS = 50_000  # node rows held as Python tuples at a time: about 20 MB

_INT, _STR, _BOOL = pa.int32(), pa.string(), pa.bool_()
_FIELDS = [
    ("node_id", _INT), ("parent_id", _INT), ("depth", _INT), ("field", _STR), ("node_type", _STR), ("name", _STR),
    ("ctx", _STR), ("ctl_depth", _INT), ("call_depth", _INT), ("def_depth", _INT), ("scope_fn", _INT),
    ("last_fn", _STR), ("open_fn", _STR), ("known", _BOOL), ("owner", _STR), ("cfg_parent", _INT),
    ("is_docstr", _BOOL),
]
FIELDS = tuple(name for name, _ in _FIELDS)
_CONTROL = frozenset((ast.If, ast.For, ast.While, ast.Try, ast.With))
_WITH_CTX = frozenset((ast.Name, ast.Attribute, ast.Subscript, ast.Starred, ast.List, ast.Tuple))
_FLOW = {ast.FunctionDef: ("body",), ast.If: ("body", "orelse"), ast.For: ("body",), ast.While: ("body",)}
_BROKEN = (ValueError, RecursionError, MemoryError)


def _parse(code: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(code)


def _dedented(lines: list[str]) -> list[str]:
    margin = min(len(x) - len(x.lstrip()) for x in lines if x.strip())
    return [x[margin:] if x.strip() else "" for x in lines]


def candidates(code: str, mode: str) -> list[tuple[str, str]]:
    """Texts to try in turn, with the status that each would give.

    extractor keeps inner blank lines, label drops them; both fall back to a function wrapper. raw parses as given.
    """
    if mode == "raw":
        return [("ok", code)]
    lines = code.split("\n")
    if mode == "label":
        lines = [x for x in lines if x.strip()]
    else:
        first = next(i for i, x in enumerate(lines) if x.strip())
        lines = lines[first:]
    lines = _dedented(lines)
    return [("ok", "\n".join(lines)), ("wrapped", "def wrapper():\n" + "".join(f"    {x}\n" for x in lines))]


def parse_snippet(code: str | None, mode: str):
    """(status, tree): status is ok, wrapped, blank, syntax or limit; tree is None unless ok or wrapped.

    limit means that the parser gave up for a reason other than the syntax.
    """
    if code is None or (mode != "raw" and not code.strip()):
        return "blank", None
    status = "syntax"
    for name, text in candidates(code, mode):
        try:
            return name, _parse(text)
        except SyntaxError:
            continue
        except _BROKEN:
            status = "limit"
            if mode == "label":
                break
    return status, None


def walk_nodes(tree) -> list[tuple]:
    """Node tuples in the order of `_FIELDS`, pre-order, children in the order of the syntax fields."""
    rows: list[tuple] = []
    defined: set[str] = set()
    last_fn = open_fn = None
    # (node, parent id, depth, field, control depth, call depth, definition depth, function scope, flow parent, owner)
    stack: list = [(tree, -1, 0, None, 0, 0, 0, -1, -1, None)]
    while stack:
        item = stack.pop()
        if item is None:  # a function has ended
            open_fn = None
            continue
        node, parent, depth, field, ctl, calls, defs, scope, flow, owner = item
        kind = node.__class__
        me = len(rows)
        if not kind._fields:  # contexts and operators
            rows.append((me, parent, depth, field, kind.__name__, None, None, ctl, calls, defs, -1, last_fn, open_fn,
                         False, None, None, False))
            continue
        name = ctx = holder = None
        known = docstr = is_fn = False
        local = -1
        if kind is ast.Name:
            name = node.id
            ctx = node.ctx.__class__.__name__
            if ctx == "Store":
                local = scope
        elif kind is ast.Call:
            calls += 1
            if node.func.__class__ is ast.Name:
                name = node.func.id
                known = name in defined
        elif kind is ast.FunctionDef:
            is_fn = True
            defs += 1
            last_fn = open_fn = name = node.name
            defined.add(name)
        elif kind is ast.ClassDef:
            defs += 1
            name = holder = node.name
        elif kind is ast.arg:
            name = node.arg
            if field == "args" and rows[parent][3] == "args" and rows[rows[parent][1]][4] == "FunctionDef":
                local = scope
        elif kind is ast.Expr:
            docstr = node.value.__class__ is ast.Constant and isinstance(node.value.value, str)
        elif kind in _WITH_CTX:
            ctx = node.ctx.__class__.__name__
        fields = _FLOW.get(kind)
        rows.append((me, parent, depth, field, kind.__name__, name, ctx, ctl, calls, defs, local, last_fn, open_fn,
                     known, owner if is_fn else None, flow if fields and flow is not None else None, docstr))
        if is_fn:
            stack.append(None)
            scope = me
        if kind in _CONTROL:
            ctl += 1
        children = []
        for child_field in kind._fields:
            value = getattr(node, child_field, None)
            if value.__class__ is not list:
                if not isinstance(value, ast.AST):
                    continue
                value = (value,)
            if flow is None or fields is None:
                below = flow
            else:
                below = me if child_field in fields else None
            inside = holder if child_field == "body" else None
            for child in value:
                if isinstance(child, ast.AST):
                    children.append((child, me, depth + 1, child_field, ctl, calls, defs, scope, below, inside))
        children.reverse()
        stack.extend(children)
    return rows


def _nodes_ddl(fields: tuple[str, ...]) -> str:
    kinds = dict(part.split(":") for part in NODE_DDL[len("array<struct<"):-2].split(","))
    return "array<struct<" + ",".join(f"{name}:{kinds[name]}" for name in fields) + ">>"


class _NodeLists:
    """Collects the given fields of the node rows of many snippets into one Arrow list array, `CHUNK_ROWS` rows at a time."""

    def __init__(self, fields: tuple[str, ...]):
        self.fields = [(FIELDS.index(name), *_FIELDS[FIELDS.index(name)]) for name in fields]
        self.offsets, self.rows, self.missing, self.chunks = [0], [], [], []

    def add(self, rows: list | None) -> None:
        self.rows.extend(rows or ())
        self.offsets.append(self.offsets[-1] + len(rows or ()))
        self.missing.append(rows is None)
        if len(self.rows) >= CHUNK_ROWS:
            self._close()

    def _close(self) -> None:
        self.chunks.append(pa.StructArray.from_arrays([pa.array([r[i] for r in self.rows], type=t) for i, _, t in self.fields],
                                                      fields=[pa.field(n, t) for _, n, t in self.fields]))
        self.rows = []

    def array(self) -> pa.Array:
        self._close()
        nodes = pa.concat_arrays(self.chunks)
        return pa.ListArray.from_arrays(pa.array(self.offsets, type=pa.int32()), nodes,
                                        mask=pa.array(self.missing, type=_BOOL) if any(self.missing) else None)


def _rows(tree) -> list:
    return walk_nodes(tree) if tree is not None else []


def _dealt(parsed: pa.Array, indices: pa.Array) -> pa.Array:
    """The results of the distinct snippets, one for each row."""
    if len(parsed) == len(indices) and not indices.null_count:  # all distinct, and numbered in their order
        return parsed
    return parsed.take(indices)


def _batch_parser(mode: str, fields: tuple[str, ...]):
    def parse_batch(codes: pa.Array) -> pa.Array:
        distinct = codes.dictionary_encode()
        status, lists = [], _NodeLists(fields)
        for code in distinct.dictionary.to_pylist():
            state, tree = parse_snippet(code, mode)
            status.append(state)
            lists.add(_rows(tree))
        parsed = pa.StructArray.from_arrays([pa.array(status, type=_STR), lists.array()], names=["status", "nodes"])
        return _dealt(parsed, distinct.indices)

    return parse_batch


def _both_parser(fields: tuple[str, ...]):
    def parse_batch(codes: pa.Array) -> pa.Array:
        distinct = codes.dictionary_encode()
        status, label_status, lists, label_lists = [], [], _NodeLists(fields), _NodeLists(fields)
        for code in distinct.dictionary.to_pylist():
            state, tree = parse_snippet(code, "extractor")
            status.append(state)
            lists.add(_rows(tree))
            if code and code.strip() and candidates(code, "extractor") == candidates(code, "label"):
                label_status.append(state)
                label_lists.add(None)
            else:
                state, tree = parse_snippet(code, "label")
                label_status.append(state)
                label_lists.add(_rows(tree))
        parsed = pa.StructArray.from_arrays(
            [pa.array(status, type=_STR), lists.array(), pa.array(label_status, type=_STR), label_lists.array()],
            names=["status", "nodes", "label_status", "label_nodes"])
        return _dealt(parsed, distinct.indices)

    return parse_batch


def parse_both(code: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """STRUCT<status, nodes, label_status, label_nodes>: extractor and label mode in one pass; nodes have the given fields.

    label_nodes is null where both modes parse the same text (no blank lines), which is then parsed and sent once.
    """
    nodes = _nodes_ddl(fields)
    return F.arrow_udf(_both_parser(fields), f"struct<status:string,nodes:{nodes},label_status:string,label_nodes:{nodes}>")(code)


def parse_nodes(code: Column, mode: str = "extractor", fields: tuple[str, ...] = FIELDS) -> Column:
    """STRUCT<status, nodes> for a code column; nodes have the given fields, and only these are sent."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return F.arrow_udf(_batch_parser(mode, fields), f"struct<status:string,nodes:{_nodes_ddl(fields)}>")(code)


def register(spark: SparkSession) -> None:
    """SQL functions parse_extractor(code), parse_label(code) and parse_raw(code)."""
    for mode in MODES:
        spark.udf.register(f"parse_{mode}", F.arrow_udf(_batch_parser(mode, FIELDS), f"struct<status:string,nodes:{NODE_DDL}>"))
