"""Defect rules for Python, as queries over the syntax-node table.

A node row lists its direct children and the statements around it, so most
rules look at one row: they are array expressions, and all of them run in one
scan. The others meet on ``(snippet_id, node)`` or ``(snippet_id, name)``:
equality joins only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.text import issue_fix, issue_name

LOOPS = ["For", "While"]


def _issues(df: DataFrame, rule: str, phase: int, *args, line: Column | str = "line",
            o1: Column | str = "node", o2: Column | int = 0) -> DataFrame:
    """Issue rows; ``args`` fill the fix text."""
    line = F.col(line) if isinstance(line, str) else line
    o1 = F.col(o1) if isinstance(o1, str) else o1
    o2 = F.lit(o2) if isinstance(o2, int) else o2
    public = rule.rstrip("ab")
    return df.select(
        "snippet_id", F.lit(public).alias("rule"), issue_name(rule).alias("name"),
        line.cast("int").alias("line"), issue_fix(rule, *args).alias("fix"),
        F.lit(phase).alias("phase"), o1.cast("bigint").alias("o1"), o2.cast("bigint").alias("o2"))


def _kids(field: str) -> Column:
    return F.filter("kids", lambda k: k["field"] == field)


def _kid(field: str) -> Column:
    """The child in a single-valued field, null if absent."""
    return F.try_element_at(_kids(field), F.lit(1))


def _around() -> Column:
    """The nearest enclosing statement, null at module level."""
    return F.try_element_at("path", F.lit(-1))


def _inside(*types: str, field: str | None = None) -> Column:
    """Is the node anywhere below one of these statements?"""
    def test(p):
        hit = p["type"].isin(*types)
        return hit & (p["field"] == field) if field else hit
    return F.exists("path", test)


def _of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.filter(F.col("type").isin(*types))


def _above(df: DataFrame, *types: str, keep: tuple = ()) -> DataFrame:
    """One row per enclosing statement of these types: ``up`` is its path entry."""
    return df.select("snippet_id", "node", "line", *keep, F.explode(
        F.filter("path", lambda p: p["type"].isin(*types))).alias("up"))


def _in_set(kid: Column, pairs: list[tuple]) -> Column:
    """Is the child one of these constants, given as (type, text)?"""
    return reduce(Column.__or__,
                  [(kid["const_type"] == t) & (kid["const"] == c) for t, c in pairs])


def _is_none(kid: Column) -> Column:
    return kid["const_type"] == "NoneType"


ZEROS = [("int", "0"), ("float", "0.0"), ("complex", "0j"), ("bool", "False")]
ONES = [("int", "1"), ("float", "1.0"), ("complex", "(1+0j)"), ("bool", "True")]


ENTRY = "struct<rule:string,name:string,line:int,fix:string,phase:int,o1:bigint,o2:bigint>"


def _entry(rule: str, phase: int, *args, line: Column | None = None, o1: Column | None = None,
           o2: Column | int = 0) -> Column:
    """An issue found in the row at hand."""
    line = F.col("line") if line is None else line
    o1 = F.col("node") if o1 is None else o1
    o2 = F.lit(o2) if isinstance(o2, int) else o2
    return F.struct(F.lit(rule.rstrip("ab")), issue_name(rule), line, issue_fix(rule, *args),
                    F.lit(phase), o1, o2).cast(ENTRY)


def _found(types: list[str], test: Column, entry: Column) -> Column:
    """One issue if a node of these types passes the test."""
    return F.when(F.col("type").isin(types) & test, F.array(entry))


# ---- rules on one row ------------------------------------------------------

def infinite_loops() -> Column:
    return _found(["While"], _in_set(_kid("test"), [("bool", "True")]), _entry("PY-1", 1))


def zero_divisions() -> Column:
    divides = F.try_element_at("ops", F.lit(1)) == "Div"
    return _found(["BinOp"], divides & _in_set(_kid("right"), ZEROS), _entry("PY-2", 1, o2=1))


def input_in_loops() -> Column:
    func = _kid("func")
    test = (func["type"] == "Name") & (func["name"] == "input") & _inside(*LOOPS)
    return _found(["Call"], test, _entry("PY-3", 1, o2=2))


def sort_in_loops() -> Column:
    func = _kid("func")
    test = (func["type"] == "Attribute") & (func["name"] == "sort") & _inside(*LOOPS)
    return _found(["Call"], test, _entry("PY-4", 1, o2=3))


def nested_loops() -> Column:
    return _found(LOOPS, _inside("For"), _entry("PY-5", 2))


def mutable_defaults() -> Column:
    mutable = F.arrays_overlap("sig.defaults", F.array(*map(F.lit, ["List", "Dict", "Set"])))
    return _found(["FunctionDef"], mutable, _entry("PY-10", 5, F.col("name")))


def shadowed_builtins() -> Column:
    names = fixed.SHADOWED_BUILTINS
    targets = F.filter("names", lambda n: n.isin(names))
    return F.when(
        F.col("type").isin("Assign", "AugAssign", "AnnAssign"),
        F.transform(targets, lambda n, i: _entry("PY-11a", 6, n, o2=i)),
    ).when((F.col("type") == "FunctionDef") & F.col("name").isin(names),
           F.array(_entry("PY-11b", 6, F.col("name"))))


def _comparisons(ops: list[str], test, entry) -> Column:
    """``entry(right, position)`` per operator of a comparison whose right side passes."""
    pairs = F.arrays_zip(F.col("ops"), _kids("comparators").alias("right"))
    placed = F.transform(pairs, lambda p, i: F.struct(
        p["ops"].alias("op"), p["right"].alias("right"), i.alias("pos")))
    hits = F.filter(placed, lambda p: p["op"].isin(ops) & test(p["right"]))
    return F.when(F.col("type") == "Compare",
                  F.transform(hits, lambda p: entry(p["right"], p["pos"])))


def none_comparisons() -> Column:
    return _comparisons(["Eq", "NotEq"], _is_none, lambda right, pos: _entry("PY-12", 7, o2=pos))


def literal_identities() -> Column:
    # 0, 1 and their equals count as the singletons True and False.
    def test(right):
        return (right["const_type"].isNotNull() & ~_is_none(right)
                & ~F.coalesce(_in_set(right, ZEROS + ONES), F.lit(False)))

    return _comparisons(["Is", "IsNot"], test,
                        lambda right, pos: _entry("PY-13", 8, right["const"], o2=pos))


def float_equalities() -> Column:
    left = F.coalesce(_kid("left")["const_type"] == "float", F.lit(False))
    return _comparisons(["Eq", "NotEq"],
                        lambda right: left | (right["const_type"] == "float"),
                        lambda right, pos: _entry("PY-14", 9, o2=pos))


def _after_first(*stops: str):
    """First body statement of these types that is not the last, and the one after it."""
    body = _kids("body")
    stop = F.try_element_at(F.filter(body, lambda k: k["type"].isin(*stops)
                                     & (k["idx"] < F.size(body) - 1)), F.lit(1))
    return stop, F.try_element_at(body, stop["idx"] + 2)


def dead_code_after_return() -> Column:
    stop, after = _after_first("Return")
    return _found(["FunctionDef"], stop.isNotNull(),
                  _entry("PY-16", 11, stop["line"], line=after["line"]))


def bare_excepts() -> Column:
    test = _kid("type").isNull() & (_around()["type"] == "Try")
    return _found(["ExceptHandler"], test, _entry("PY-19", 14))


def boolean_comparisons() -> Column:
    def entry(right, pos):
        hint = F.when(right["const"] == "True", "if x:").otherwise("if not x:")
        return _entry("PY-21", 16, hint, right["const"], o2=pos)

    return _comparisons(["Eq", "NotEq"], lambda right: right["const_type"] == "bool", entry)


def missing_self() -> Column:
    first = F.coalesce(F.try_element_at("sig.args", F.lit(1)), F.lit(""))
    return _found(["FunctionDef"], F.col("name").isin(fixed.SELF_METHODS) & (first != "self"),
                  _entry("PY-22", 17, F.col("name")))


def dead_code_after_break() -> Column:
    stop, after = _after_first("Break", "Continue")
    return _found(LOOPS, stop.isNotNull(), _entry("PY-24", 19, F.lower(stop["type"]),
                                                  stop["line"], line=after["line"]))


def shadowed_loop_variables() -> Column:
    def shared(outer):
        return F.transform(F.array_intersect(F.col("names"), outer["names"]),
                           lambda v: _entry("PY-15", 10, v, o1=outer["node"], o2=F.col("node")))

    outer = F.filter("path", lambda p: p["type"] == "For")
    return F.when(F.col("type") == "For", F.flatten(F.transform(outer, shared)))


def mutated_while_iterating() -> Column:
    func = _kid("func")
    loop = F.try_element_at(F.filter("path", lambda p: p["over"] == func["base"]), F.lit(1))
    test = (func["type"] == "Attribute") & func["name"].isin(fixed.MUTATING_METHODS)
    return _found(["Call"], test & loop.isNotNull(), _entry(
        "PY-18", 13, func["name"], func["base"], o1=loop["node"], o2=F.col("node")))


ROW_RULES = {
    "PY-1": infinite_loops, "PY-2": zero_divisions, "PY-3": input_in_loops, "PY-4": sort_in_loops,
    "PY-5": nested_loops, "PY-10": mutable_defaults, "PY-11": shadowed_builtins,
    "PY-12": none_comparisons, "PY-13": literal_identities, "PY-14": float_equalities,
    "PY-15": shadowed_loop_variables, "PY-16": dead_code_after_return,
    "PY-18": mutated_while_iterating, "PY-19": bare_excepts, "PY-21": boolean_comparisons,
    "PY-22": missing_self, "PY-24": dead_code_after_break,
}


def row_issues(nodes: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """The chosen one-row rules in one scan of the node table."""
    none = F.array().cast(f"array<{ENTRY}>")
    found = F.flatten(F.array(*[F.coalesce(ROW_RULES[r](), none) for r in rules or ROW_RULES]))
    rows = _of_type(nodes, "While", "For", "BinOp", "Call", "FunctionDef", "Assign", "AugAssign",
                    "AnnAssign", "Compare", "ExceptHandler")
    return rows.select("snippet_id", F.inline(found)).select(
        "snippet_id", "rule", "name", "line", "fix", "phase", "o1", "o2")


# ---- rules that join -------------------------------------------------------

def _nth_target() -> Column:
    """Order of the targets of one statement, after that of the statements."""
    return F.shiftleft(F.col("node").cast("bigint"), 31) + F.col("nth")


def _below(nodes: DataFrame) -> DataFrame:
    """What lies below each function and each if: returns, calls of itself, tests."""
    func = _kid("func")
    inner = _of_type(nodes, "Return", "Call", "If").withColumn(
        "called", F.when((F.col("type") == "Call") & (func["type"] == "Name"), func["name"])
    ).withColumn("valued", (F.col("type") == "Return") & _kid("value").isNotNull())
    is_return, field = F.col("type") == "Return", F.col("up.field")
    return _above(inner, "FunctionDef", "If", keep=("type", "called", "valued")).groupBy(
        "snippet_id", F.col("up.node").alias("node")).agg(
        F.max(is_return).alias("returns"), F.max("valued").alias("returns_value"),
        F.max(is_return & (field == "body")).alias("body_returns"),
        F.max(is_return & (field == "orelse")).alias("else_returns"),
        F.max(F.coalesce(F.col("called") == F.col("up.name"), F.lit(False))).alias("calls_self"),
        F.max(F.col("type") == "If").alias("guarded"))


FUNCTION_RULES = ("PY-6", "PY-7", "PY-17")


def function_rules(nodes: DataFrame, rules: tuple = FUNCTION_RULES) -> DataFrame:
    """PY-6, PY-7 and PY-17, which all ask what lies below a function or an if."""
    around = _around()
    is_def = F.col("type") == "FunctionDef"
    # Functions, and the ifs with an else at the top of a function.
    heads = _of_type(nodes, "FunctionDef", "If").select(
        "snippet_id", "node", "line", "type",
        F.when(is_def, F.col("node")).when(
            (around["type"] == "FunctionDef") & (around["field"] == "body")
            & (F.size(_kids("orelse")) > 0), around["node"]).alias("func"))
    facts = ["returns", "returns_value", "body_returns", "else_returns", "calls_self", "guarded"]
    known = (heads.filter("func is not null")
             .join(_below(nodes), ["snippet_id", "node"], "left").fillna(False, facts))
    if "PY-17" in rules:
        known = known.withColumn("func_value", F.max(is_def & F.col("returns_value")).over(
            Window.partitionBy("snippet_id", "func")))
    else:
        known = known.filter(is_def).withColumn("func_value", F.lit(False))
    found = {
        "PY-6": F.when(is_def & ~F.col("returns"), _entry("PY-6", 2, o2=1)),
        "PY-7": F.when(is_def & F.col("calls_self") & ~F.col("guarded"), _entry("PY-7", 2, o2=2)),
        "PY-17": F.when(~is_def & F.col("func_value")
                        & (F.col("body_returns") != F.col("else_returns")),
                        _entry("PY-17", 12, o1=F.col("func"), o2=F.col("node"))),
    }
    entries = F.filter(F.array(*[found[r] for r in rules]), lambda e: e.isNotNull())
    return known.select("snippet_id", F.inline(entries)).select(
        "snippet_id", "rule", "name", "line", "fix", "phase", "o1", "o2")


def no_returns(nodes: DataFrame) -> DataFrame:
    return function_rules(nodes, ("PY-6",))


def bare_recursions(nodes: DataFrame) -> DataFrame:
    return function_rules(nodes, ("PY-7",))


def missing_branch_returns(nodes: DataFrame) -> DataFrame:
    return function_rules(nodes, ("PY-17",))


def overwritten_accumulators(nodes: DataFrame) -> DataFrame:
    value = _kid("value")
    is_seed = (_in_set(value, ZEROS + [("str", "''")])
               | (value["type"].isin("List", "Dict", "Set") & (value["n"] == 0)))
    assigns = _of_type(nodes, "Assign")
    seeds = assigns.filter(is_seed).select(
        "snippet_id", F.explode("names").alias("target")).distinct()
    rows = (
        _above(assigns, "For", keep=("names", "uses"))
        .filter(F.arrays_overlap("up.names", "uses"))
        .select("snippet_id", "node", "line", "up", "uses",
                F.posexplode("names").alias("nth", "target"))
        .filter(~F.array_contains("up.names", F.col("target"))
                & ~F.array_contains("uses", F.col("target")))
        .join(seeds, ["snippet_id", "target"], "left_semi")
    )
    return _issues(rows, "PY-8", 3, F.col("target"), o1="up.node", o2=_nth_target())


def _functions(nodes: DataFrame) -> DataFrame:
    return _of_type(nodes, "FunctionDef")


def wrong_argument_counts(nodes: DataFrame) -> DataFrame:
    defs = _functions(nodes).groupBy("snippet_id", F.col("name").alias("callee")).agg(
        F.max_by(F.struct(F.size("sig.args").alias("most"),
                          (F.size("sig.args") - F.col("sig.n_defaults")).alias("least"),
                          F.col("sig.open").alias("open"), F.col("line").alias("line")),
                 "node").alias("def"))
    func = _kid("func")
    calls = _of_type(nodes, "Call").filter(func["type"] == "Name").select(
        "snippet_id", "node", "line", func["name"].alias("callee"),
        (F.size(_kids("args")) + F.size(_kids("keywords"))).alias("given"))
    rows = calls.join(defs, ["snippet_id", "callee"]).filter("not def.open")
    few = _issues(rows.filter("given < def.least"), "PY-9a", 4, F.col("callee"),
                  F.col("def.least"), F.col("given"), F.col("def.line"))
    many = _issues(rows.filter("given >= def.least and given > def.most"), "PY-9b", 4,
                   F.col("callee"), F.col("def.most"), F.col("given"), F.col("def.line"))
    return few.unionByName(many)


def returns_in_finally(nodes: DataFrame) -> DataFrame:
    rows = (_above(_of_type(nodes, "Return"), "Try").filter("up.field = 'finalbody'")
            .groupBy("snippet_id", F.col("up.node").alias("try"))
            .agg(F.min_by("line", "node").alias("line")))
    return _issues(rows, "PY-20", 15, o1="try")


def missing_globals(nodes: DataFrame) -> DataFrame:
    top = nodes.filter(F.size("path") == 0)
    module_names = (
        _of_type(top, "Assign").select("snippet_id", F.explode("names").alias("target"))
        .union(_of_type(top, "FunctionDef", "ClassDef").select("snippet_id", "name"))
        .distinct())
    around = _around()
    declared = (_of_type(nodes, "Global").filter((around["type"] == "FunctionDef") & (around["field"] == "body"))
                .select("snippet_id", around["node"].alias("func"),
                        F.explode("names").alias("target")))
    assigns = (_above(_of_type(nodes, "Assign"), "FunctionDef", keep=("names",))
               .select("snippet_id", "node", "line", F.col("up.node").alias("func"),
                       F.col("up.name").alias("func_name"),
                       F.posexplode("names").alias("nth", "target"))
               .filter("target <> func_name"))
    rows = (assigns.join(module_names, ["snippet_id", "target"], "left_semi")
            .join(declared, ["snippet_id", "func", "target"], "left_anti")
            .groupBy("snippet_id", "func", "func_name", "target")
            .agg(F.min(_nth_target()).alias("first"), F.min_by("line", "node").alias("line")))
    return _issues(rows, "PY-23", 18, F.col("target"), F.col("func_name"), o1="func",
                   o2=F.col("first"))


def unused_variable_rows(nodes: DataFrame) -> DataFrame:
    """``snippet_id, target, first, line``: names assigned but never read."""
    # An augmented or annotated name is reported where the name stands.
    line = F.when(F.col("type") == "Assign", F.col("line")).otherwise(_kid("target")["line"])
    assigned = (_of_type(nodes, "Assign", "AugAssign", "AnnAssign")
                .select("snippet_id", "node", line.alias("line"),
                        F.posexplode("names").alias("nth", "target"))
                .filter(~F.col("target").startswith("_"))
                .groupBy("snippet_id", "target")
                .agg(F.min_by("line", "node").alias("line"), F.min(_nth_target()).alias("first")))
    read = F.when((F.col("type") == "Name") & (F.col("ctx") == "Load"), F.array("name")).when(
        F.col("type") == "FunctionDef", F.concat("sig.args", "sig.other"))
    used = _of_type(nodes, "Name", "FunctionDef").select(
        "snippet_id", F.explode(read).alias("target")).distinct()
    return assigned.join(used, ["snippet_id", "target"], "left_anti")


def unused_variables(nodes: DataFrame) -> DataFrame:
    return _issues(unused_variable_rows(nodes), "PY-25", 20, F.col("target"), o1="first")


def none_dereferences(nodes: DataFrame) -> DataFrame:
    value = _kid("value")
    state = F.when(_is_none(value), True).when(value["type"] == "Name", False)
    # The last assignment of None or of another name decides, breadth first.
    none_names = (_of_type(nodes, "Assign").withColumn("is_none", state)
                  .filter("is_none is not null")
                  .select("snippet_id", "node", "is_none", F.explode("names").alias("base"))
                  .groupBy("snippet_id", "base").agg(F.max_by("is_none", "node").alias("is_none"))
                  .filter("is_none"))
    attributes = _of_type(nodes, "Attribute").filter(value["type"] == "Name").select(
        "snippet_id", "node", "line", "name", value["name"].alias("base"))
    rows = attributes.join(none_names, ["snippet_id", "base"], "left_semi")
    return _issues(rows, "PY-26", 21, F.col("base"), F.col("name"))


JOIN_RULES = {
    "PY-6": no_returns, "PY-7": bare_recursions, "PY-8": overwritten_accumulators,
    "PY-9": wrong_argument_counts, "PY-17": missing_branch_returns, "PY-20": returns_in_finally,
    "PY-23": missing_globals, "PY-25": unused_variables, "PY-26": none_dereferences,
}
PYTHON_RULES = {rule: {**ROW_RULES, **JOIN_RULES}[rule] for rule in (
    f"PY-{i}" for i in range(1, 27))}


def rule_issues(nodes: DataFrame, rule: str) -> DataFrame:
    """Issues of one rule."""
    return row_issues(nodes, [rule]) if rule in ROW_RULES else JOIN_RULES[rule](nodes)


def python_issues(nodes: DataFrame) -> DataFrame:
    """All Python rules but the loop count rule, which needs the features."""
    joined = [fn(nodes) for rule, fn in JOIN_RULES.items() if rule not in FUNCTION_RULES]
    return reduce(DataFrame.unionByName, [row_issues(nodes), function_rules(nodes), *joined])
