"""Syntax-node table of Python snippets: the only step that needs Python code.

Each text is parsed with the standard ``ast`` module and written out as rows.
No rule is applied here; a row holds what the parser says about one node, a
short description of its direct children, and the statements that enclose it.
Of a chain of ``elif`` arms only the first ``if`` is listed among those, so the rows
of a chain grow with its length; ``level`` counts all of them.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The few functions that run in Python workers travel with the job, so executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = """
snippet_id long, parse_ok boolean, error_line int, error_msg string,
node int, type string, field string, idx int, line int, end_line int, level int,
name string, ctx string, ops array<string>, names array<string>,
kids array<struct<field:string,idx:int,type:string,line:int,name:string,base:string,
                  const_type:string,const:string,n:int>>,
sig struct<args:array<string>,other:array<string>,defaults:array<string>,n_defaults:int,
           open:boolean>,
uses array<string>,
path array<struct<node:int,type:string,field:string,name:string,names:array<string>,over:string>>
"""
_TEXT, _INT = pa.string(), pa.int32()
_KID = pa.struct([("field", _TEXT), ("idx", _INT), ("type", _TEXT), ("line", _INT),
                  ("name", _TEXT), ("base", _TEXT), ("const_type", _TEXT), ("const", _TEXT),
                  ("n", _INT)])
_SIG = pa.struct([("args", pa.list_(_TEXT)), ("other", pa.list_(_TEXT)),
                  ("defaults", pa.list_(_TEXT)), ("n_defaults", _INT), ("open", pa.bool_())])
_STEP = pa.struct([("node", _INT), ("type", _TEXT), ("field", _TEXT), ("name", _TEXT),
                   ("names", pa.list_(_TEXT)), ("over", _TEXT)])
ARROW_SCHEMA = pa.schema([
    ("snippet_id", pa.int64()), ("parse_ok", pa.bool_()), ("error_line", _INT),
    ("error_msg", _TEXT), ("node", _INT), ("type", _TEXT), ("field", _TEXT), ("idx", _INT),
    ("line", _INT), ("end_line", _INT), ("level", _INT), ("name", _TEXT), ("ctx", _TEXT),
    ("ops", pa.list_(_TEXT)), ("names", pa.list_(_TEXT)), ("kids", pa.list_(_KID)),
    ("sig", _SIG), ("uses", pa.list_(_TEXT)), ("path", pa.list_(_STEP)),
])
BATCH = 4096
# Expressions that get a row of their own; all statements and handlers do.
KEPT_EXPR = (ast.BinOp, ast.BoolOp, ast.Call, ast.Compare, ast.Attribute, ast.Name)
# Statements that count as a level of nesting.
NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try)
MARKS = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)


# Where a node carries its name.
NAME_FIELDS = {"Name": "id", "Attribute": "attr", "arg": "arg", "keyword": "arg",
               "FunctionDef": "name", "AsyncFunctionDef": "name", "ClassDef": "name",
               "ExceptHandler": "name", "alias": "name"}


def _name(node):
    field = NAME_FIELDS.get(type(node).__name__)
    return getattr(node, field) if field else None


def _literal(node, parent):
    """Type and text of a constant; long texts only where they are compared."""
    if not isinstance(node, ast.Constant):
        return None, None
    value = node.value
    kind = type(value).__name__
    if isinstance(value, (str, bytes)) and value and not isinstance(parent, ast.Compare):
        return kind, None
    try:
        return kind, repr(value)
    except ValueError:      # an integer too long to print in decimal
        return kind, hex(value)


def _kid(field, idx, node, parent):
    const_type, const = _literal(node, parent)
    base = getattr(node, "value", None) if isinstance(node, ast.Attribute) else None
    # Parts of a list, set or dict display; other nodes have no use for the number.
    parts = getattr(node, "elts", None) or getattr(node, "keys", None)
    return {"field": field, "idx": idx, "type": type(node).__name__,
            "line": getattr(node, "lineno", None), "name": _name(node),
            "base": base.id if isinstance(base, ast.Name) else None,
            "const_type": const_type, "const": const, "n": len(parts) if parts else 0}


def _bound(node):
    """Plain names a statement binds, or declares global."""
    if isinstance(node, ast.Global):
        return list(node.names)
    if isinstance(node, ast.Assign):
        targets = node.targets
    elif isinstance(node, ast.For) and isinstance(node.target, ast.Tuple):
        targets = node.target.elts
    elif isinstance(node, (ast.For, ast.AugAssign, ast.AnnAssign)):
        targets = [node.target]
    else:
        return None
    return [t.id for t in targets if isinstance(t, ast.Name)]


def _signature(node):
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return None
    a = node.args
    defaults = a.defaults + [d for d in a.kw_defaults if d is not None]
    return {"args": [x.arg for x in a.args],
            "other": [x.arg for x in a.posonlyargs + a.kwonlyargs],
            "defaults": [type(d).__name__ for d in defaults], "n_defaults": len(a.defaults),
            "open": a.vararg is not None or a.kwarg is not None}


def _children(node):
    """``(field, index, child)`` in the order of the node's fields."""
    out = []
    for field in node._fields:
        value = getattr(node, field, None)
        if isinstance(value, list):
            out += [(field, i, v) for i, v in enumerate(value)
                    if isinstance(v, ast.AST) and not isinstance(v, MARKS)]
        elif isinstance(value, ast.AST) and not isinstance(value, MARKS):
            out.append((field, 0, value))
    return out


def _step(node, number):
    """A statement as the nodes below it list it; a loop with its variables and its source."""
    over = node.iter if isinstance(node, ast.For) else None
    return {"node": number, "type": type(node).__name__, "name": _name(node),
            "names": _bound(node) if over else None,
            "over": over.id if isinstance(over, ast.Name) else None}


def _parse(code):
    """Tree, or the line and message of the error."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code), None, None
    except SyntaxError as exc:
        return None, exc.lineno, str(exc)
    except Exception as exc:     # too deep, too large: not parsable, and no line to name
        return None, None, str(exc)


def node_rows(snippet_id, code):
    """Rows of one snippet, nodes numbered breadth first."""
    blank = {"snippet_id": snippet_id, "parse_ok": False}
    tree, line, message = _parse(code)
    if tree is None:
        yield {**blank, "error_line": line, "error_msg": message}
        return
    queue = deque([(tree, None, None, [], 0, False)])
    number = 0
    while queue:
        node, field, idx, path, level, arm = queue.popleft()
        kids = _children(node)
        is_block = isinstance(node, (ast.stmt, ast.excepthandler))
        if is_block or isinstance(node, (ast.Module, *KEPT_EXPR)):
            yield {
                "snippet_id": snippet_id, "parse_ok": True, "node": number,
                "type": type(node).__name__, "field": field, "idx": idx,
                "line": getattr(node, "lineno", None),
                "end_line": getattr(node, "end_lineno", None), "level": level,
                "name": _name(node), "names": _bound(node), "sig": _signature(node),
                "ctx": type(node.ctx).__name__ if hasattr(node, "ctx") else None,
                "ops": [type(o).__name__ for o in node.ops] if isinstance(node, ast.Compare)
                else [type(node.op).__name__] if hasattr(node, "op") else None,
                "kids": [] if isinstance(node, ast.Module)
                else [_kid(f, i, c, node) for f, i, c in kids],
                "uses": sorted({n.id for n in ast.walk(node.value) if isinstance(n, ast.Name)})
                if isinstance(node, ast.Assign) else None,
                "path": path,
            }
        step = _step(node, number) if is_block and not arm else None
        deeper = level + isinstance(node, NESTING)
        below = {f: path + [{**step, "field": f}] if step else path for f, _, _ in kids}
        for kid_field, kid_idx, kid in kids:
            further = isinstance(node, ast.If) and isinstance(kid, ast.If) and kid_field == "orelse"
            queue.append((kid, kid_field, kid_idx, below[kid_field], deeper, further))
        number += 1


def _parse_batches(batches):
    rows = []
    for batch in batches:
        ids, codes = batch.column("snippet_id").to_pylist(), batch.column("code").to_pylist()
        for snippet_id, code in zip(ids, codes):
            for row in node_rows(snippet_id, code):
                rows.append(row)
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)


def node_table(snippets: DataFrame) -> DataFrame:
    """Node rows of the Python snippets; an unparsable one gives a single row."""
    python = snippets.filter(F.col("review_language") == "python").select("snippet_id", "code")
    return python.mapInArrow(_parse_batches, NODE_SCHEMA)


def _check_texts(code: pd.Series) -> pd.DataFrame:
    found = [(True, None, None) if text is None else _parse(text) for text in code]
    found = [(tree is not None, line, message) for tree, line, message in found]
    return pd.DataFrame(found, columns=["parse_ok", "error_line", "error_msg"], dtype=object)


def parse_check(code: Column) -> Column:
    """``parse_ok, error_line, error_msg`` of a text; a null text passes unparsed."""
    return F.pandas_udf(_check_texts, "parse_ok boolean, error_line int, error_msg string")(code)


def parse_status(snippets: DataFrame) -> DataFrame:
    """``snippet_id, parse_ok, error_line, error_msg`` of the Python snippets.

    Narrower than the node table when only the status is needed.
    """
    python = snippets.filter(F.col("review_language") == "python")
    return python.select("snippet_id", parse_check("code").alias("s")).select("snippet_id", "s.*")
