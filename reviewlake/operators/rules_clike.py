"""Defect rules for C++ and Java, as queries over the line table.

Every rule gives rows ``snippet_id, rule, name, line, fix, phase, o1, o2``;
the last three are the order in which a sequential review would report them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.issue_texts import ISSUE_TEXTS, OUT_OF_BOUNDS_KIND
from reviewlake.functions.text import has, issue_fix, issue_name, lookup, strip
from reviewlake.operators.lines import LINE_RULES

ISSUE_COLUMNS = ["snippet_id", "rule", "name", "line", "fix", "phase", "o1", "o2"]


def _by_line(*keys: str):
    return Window.partitionBy(*(keys or ("snippet_id",))).orderBy("n")


def _backwards(*keys: str):
    # "The next row that ..." is read from the end: a frame that reaches to the
    # last row would be evaluated anew for each row.
    return Window.partitionBy(*(keys or ("snippet_id",))).orderBy(F.col("n").desc())


def _fixed_text_issues(df: DataFrame, rule: Column, line: Column, phase: Column, o1: Column,
                       o2: Column) -> DataFrame:
    """Issue rows for rules whose texts hold no values of the snippet."""
    rules = [r for r, (_, fix) in ISSUE_TEXTS.items() if r.startswith("CJ-") and "{0}" not in fix]
    return df.select(
        "snippet_id", rule.alias("rule"),
        lookup(rule, {r: ISSUE_TEXTS[r][0] for r in rules}).alias("name"),
        line.cast("int").alias("line"),
        lookup(rule, {r: ISSUE_TEXTS[r][1] for r in rules}).alias("fix"),
        phase.cast("int").alias("phase"), o1.cast("bigint").alias("o1"),
        o2.cast("bigint").alias("o2"))


def line_issues(facts: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """CJ-1 .. CJ-17: all chosen rules in one pass over the line table."""
    rules = rules or list(LINE_RULES)
    # A line that passes no test, the loop test included, plays no part.
    facts = facts.filter(F.size("tests") > 0).select("snippet_id", "n", "has_loop", "tests")
    # A loop is recent when at most six lines back; for nested loops the line
    # itself does not count.
    window = _by_line()
    before = window.rangeBetween(-fixed.RECENT_LINES, -1)
    upto = window.rangeBetween(-fixed.RECENT_LINES, 0)
    if any(LINE_RULES[r] for r in rules):
        facts = (facts
                 .withColumn("loop_before", F.coalesce(F.max("has_loop").over(before), F.lit(False)))
                 .withColumn("loop_upto", F.max("has_loop").over(upto)))
    found = []
    for rule in rules:
        cond = F.array_contains("tests", rule)
        if LINE_RULES[rule]:
            cond = cond & F.col("loop_before" if rule == "CJ-1" else "loop_upto")
        found.append(F.when(cond, F.lit(rule)))
    rows = facts.select(
        "snippet_id", "n",
        F.explode(F.filter(F.array(*found), lambda r: r.isNotNull())).alias("rule"))
    number = F.substring("rule", 4, 2).cast("int")
    return _fixed_text_issues(rows, F.col("rule"), F.col("n"), F.lit(2), F.col("n"), number)


FILE_RULES = ["CJ-20", "CJ-18", "CJ-21", "CJ-22", "CJ-23", "CJ-24"]


def file_issues(clean: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Rules on a whole text, reported at line 0."""
    text = F.col("clean")
    cpp, java = F.col("review_language") == "cpp", F.col("review_language") == "java"
    tests = {
        "CJ-18": cpp & has(text, fixed.CPP_FILE_OVERFLOW),
        "CJ-20": cpp & has(text, fixed.PRINTF) & has(text, fixed.COUT) & ~has(text, fixed.SYNC_OFF),
        "CJ-21": has(text, fixed.EMPTY_CATCH),
        "CJ-22": java & has(text, fixed.JAVA_DEREF) & ~has(text, fixed.JAVA_NULL_TEST)
        & has(text, fixed.JAVA_NULL_WORD),
        "CJ-23": cpp & has(text, fixed.ALLOC["cpp"]) & ~has(text, fixed.RELEASE["cpp"]),
        "CJ-24": java & has(text, fixed.ALLOC["java"]) & ~has(text, fixed.RELEASE["java"]),
    }
    found = F.array(*[F.when(tests[r], F.lit(r)) for r in rules or FILE_RULES])
    rows = clean.select("snippet_id", F.explode(F.filter(found, lambda r: r.isNotNull()))
                        .alias("rule"))
    phase = lookup(F.col("rule"), {r: 4 + i for i, r in enumerate(FILE_RULES)})
    return _fixed_text_issues(rows, F.col("rule"), F.lit(0), phase, F.lit(0), F.lit(0))


def switch_issues(facts: DataFrame) -> DataFrame:
    """CJ-19: a case that runs into the next case, or into the end of the switch."""
    line = _by_line()
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    no = F.lit(False)
    # Only texts with a switch, and of them the lines that change the state.
    depth = (
        facts.filter("switch_word")
        .filter("opens <> closes or is_switch or is_case or is_break")
        .select("snippet_id", "n", "opens", "closes", "is_switch", "is_case", "is_break")
        .withColumn("depth", F.sum(F.col("opens") - F.col("closes")).over(upto))
    )
    # A segment runs from one switch line to the next; `base` is the depth after its first line.
    seg = (
        depth.withColumn("seg", F.last(F.when(F.col("is_switch"), F.col("n")), True).over(upto))
        .withColumn("base", F.last(F.when(F.col("is_switch"), F.col("depth")), True).over(upto))
        .filter("seg is not null and base <> 0")
        .withColumn("below", F.col("depth") < F.col("base"))
    )
    in_seg = _by_line("snippet_id", "seg")
    live = (
        seg.withColumn("was_below", F.coalesce(F.max("below").over(
            in_seg.rowsBetween(Window.unboundedPreceding, -1)), no))
        .filter("not was_below")          # lines after the end of the switch play no part
        .withColumn("is_close", F.col("below"))
        .withColumn("live_case", ~F.col("below") & F.col("is_case"))
        .withColumn("live_break", ~F.col("below") & F.col("is_break"))
        .withColumn("run", F.coalesce(F.sum(F.col("is_close").cast("int")).over(before), F.lit(0)))
        .withColumn("part", F.sum(F.col("live_case").cast("int"))
                    .over(_by_line("snippet_id", "run").rowsBetween(Window.unboundedPreceding, 0)))
    )
    parts = live.groupBy("snippet_id", "run", "part").agg(
        F.min(F.when(F.col("live_case"), F.col("n"))).alias("n"),
        F.max("live_break").alias("broken"), F.max("is_close").alias("closed"))
    following = F.lead("part").over(Window.partitionBy("snippet_id", "run").orderBy("part"))
    rows = (parts.withColumn("next_part", following)
            .filter((F.col("part") >= 1) & ~F.col("broken")
                    & (F.col("closed") | F.col("next_part").isNotNull())))
    return _fixed_text_issues(rows, F.lit("CJ-19"), F.col("n"), F.lit(3), F.col("n"), F.lit(0))


def function_extents(facts: DataFrame) -> DataFrame:
    """One row per opened non-void function, with what its lines hold.

    A body ends at the first later line that goes below its depth. Each line
    gives one row per depth it leaves, so the end is the next row at the
    function's own depth: an equality window, no join of functions and lines.
    """
    line = _by_line()
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    later = _backwards().rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("snippet_id")
    ret, guard = F.col("is_return").cast("int"), F.col("is_guard").cast("int")
    is_func = F.col("func_name").isNotNull()

    lines = (
        facts.filter("opens > 0 or closes > 0 or func_name is not null or is_return or is_guard "
                     "or size(calls) > 0")
        .select("snippet_id", "n", "opens", "closes", "leading", "func_name", "func_brace",
                "is_return", "is_guard", "calls")
        .withColumns({
            "before": F.coalesce(F.sum(F.col("opens") - F.col("closes")).over(before),
                                 F.lit(0)).cast("int"),
            "rets": F.sum(ret).over(upto), "guards": F.sum(guard).over(upto),
            "all_rets": F.sum(ret).over(whole), "all_guards": F.sum(guard).over(whole)})
        .withColumn("after", F.col("before") + F.col("opens") - F.col("closes"))
        .withColumn("cur", F.greatest(F.lit(0), F.col("before") - F.col("leading")))
    )
    opening = F.struct("n", "cur", "after", "rets", "guards")
    lines = (
        lines.withColumns({
            "next_open": F.last(F.when(F.col("opens") > 0, opening), True).over(later),
            "next_waiting": F.last(F.when(is_func & ~F.col("func_brace"), F.col("n")), True)
            .over(later)})
        # A signature without brace waits for the next brace, unless another such
        # signature comes first.
        .withColumn("open", F.when(is_func & F.col("func_brace"), opening).when(
            is_func & (F.col("next_waiting").isNull()
                       | (F.col("next_open.n") < F.col("next_waiting"))), F.col("next_open")))
    )

    kind = "struct<kind:string,name:string,level:int,n:int,line:int,after:int,rets:bigint," \
           "guards:bigint,last:int>"
    nul = F.lit(None)

    def event(kind_, name, level, n, line_, after, rets, guards, last):
        return F.struct(F.lit(kind_), name, level, n, line_, after, rets, guards, last).cast(kind)

    func = F.when(F.col("open").isNotNull(), F.array(event(
        "func", F.col("func_name"), F.col("open.cur") + 1, F.col("open.n"), F.col("n"),
        F.col("open.after"), F.col("open.rets"), F.col("open.guards"), nul)))
    calls = F.transform("calls", lambda c: event(
        "call", c, nul, F.col("n"), nul, nul, nul, nul, nul))
    low = F.least("cur", "after")

    def leave(level):
        early = F.col("cur") < level     # ends before this line, else with it
        return event("end", nul, level, F.col("n"), nul, nul,
                     F.col("rets") - F.when(early, ret).otherwise(0),
                     F.col("guards") - F.when(early, guard).otherwise(0),
                     F.col("n") - F.when(early, 1).otherwise(0))

    ends = F.when(low < F.col("before"),
                  F.transform(F.sequence(low + 1, F.col("before")), leave))
    none = F.array().cast(f"array<{kind}>")
    events = lines.select(
        "snippet_id", "all_rets", "all_guards",
        F.explode(F.concat(F.coalesce(func, none), calls, F.coalesce(ends, none))).alias("e"),
    ).select("snippet_id", "all_rets", "all_guards", "e.*")

    after_this = _backwards("snippet_id", "name").rangeBetween(Window.unboundedPreceding, -1)
    at_level = _backwards("snippet_id", "level").rangeBetween(Window.unboundedPreceding, -1)
    is_call, is_end = F.col("kind") == "call", F.col("kind") == "end"
    end = F.struct("last", "rets", "guards")
    closed_at_once = F.col("after") < F.col("level")
    return (
        events.withColumn("next_call", F.last(F.when(is_call, F.col("n")), True).over(after_this))
        .filter(~is_call)
        .withColumn("end", F.last(F.when(is_end, end), True).over(at_level))
        .filter(F.col("kind") == "func")
        .select(
            "snippet_id", "name", "line",
            (~closed_at_once & (F.coalesce("end.rets", "all_rets") > F.col("rets")))
            .alias("has_return"),
            (~closed_at_once & (F.coalesce("end.guards", "all_guards") > F.col("guards")))
            .alias("has_guard"),
            (~closed_at_once & F.col("next_call").isNotNull()
             & (F.col("end").isNull() | (F.col("next_call") <= F.col("end.last"))))
            .alias("calls_self"),
        )
    )


def function_issues(facts: DataFrame, rules: tuple = ("CJ-25", "CJ-26")) -> DataFrame:
    """CJ-25 no return in a non-void function; CJ-26 recursion without a test."""
    found = {"CJ-25": ~F.col("has_return"), "CJ-26": F.col("calls_self") & ~F.col("has_guard")}
    rows = function_extents(facts).select("snippet_id", "line", F.explode(F.filter(
        F.array(*[F.when(found[r], F.lit(r)) for r in rules]), lambda r: r.isNotNull()))
        .alias("rule"))
    return _fixed_text_issues(rows, F.col("rule"), F.col("line"), F.lit(10), F.col("line"),
                              F.substring("rule", 4, 2))


def array_issues(facts: DataFrame) -> DataFrame:
    """CJ-27: a literal index not below the array's last declared size."""
    big = "decimal(38,0)"
    n_items = F.size(F.filter(F.split("init.items", ","), lambda x: strip(x) != ""))
    decls = F.filter(F.array(
        F.when(F.col("init.name") != "", F.struct(
            F.col("init.name").alias("name"), n_items.cast(big).alias("size"),
            F.lit(0).alias("k"))),
        F.when(F.col("sized.name") != "", F.struct(
            F.col("sized.name").alias("name"), F.col("sized.size").try_cast(big).alias("size"),
            F.lit(1).alias("k"))),
    ), lambda d: d.isNotNull())
    at = F.struct("n", "k")
    sizes = (facts.select("snippet_id", "n", F.inline(decls))
             .groupBy("snippet_id", "name")
             .agg(F.max_by("size", at).alias("size"), F.min(at).alias("first")))
    placed = F.transform("accesses", lambda a, i: F.struct(
        a["name"].alias("name"), a["idx"].alias("idx"), i.alias("pos")))
    accesses = facts.select("snippet_id", "review_language", "n", F.inline(placed))
    rows = (accesses.groupBy("snippet_id", "review_language", "n", "name", "idx")
            .agg(F.min("pos").alias("pos"))
            .join(sizes, ["snippet_id", "name"])
            .withColumn("i", F.col("idx").try_cast(big)).filter("i >= size"))
    return rows.select(
        "snippet_id", F.lit("CJ-27").alias("rule"), issue_name("CJ-27").alias("name"),
        F.col("n").cast("int").alias("line"),
        issue_fix("CJ-27", F.col("name"), F.col("size"), F.col("size") - 1, F.col("i"),
                  lookup(F.col("review_language"), OUT_OF_BOUNDS_KIND)).alias("fix"),
        F.lit(1).alias("phase"),
        # On a line, arrays in the order of their first declaration.
        (F.col("first.n") * 2 + F.col("first.k")).cast("bigint").alias("o1"),
        F.col("pos").cast("bigint").alias("o2"),
    )


def c_like_issues(clean: DataFrame, facts: DataFrame) -> DataFrame:
    """All C++ / Java rules but the loop count rule, which needs the features."""
    parts = [array_issues(facts), line_issues(facts), switch_issues(facts), file_issues(clean),
             function_issues(facts)]
    return reduce(DataFrame.unionByName, parts)
