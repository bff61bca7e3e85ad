"""Code features: the 12-column vector, the richer set, and the panel figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.numbers import round_half_even
from reviewlake.functions.text import (
    by_language, groups, has, hits, line_count, occurrences, split_lines, strip,
    strip_c_comments,
)
from reviewlake.operators.rules_python import unused_variable_rows
from reviewlake.sources.stage import staged

NESTING = ["If", "For", "While", "With", "Try"]


def _per_language(table: dict, text: Column) -> Column:
    return by_language(F.col("review_language"), table, lambda p: hits(text, p), F.lit(0))


def _num_lines() -> Column:
    return F.greatest(F.lit(1), line_count(F.col("code"))).cast("int").alias("num_lines")


def features_c_like(snippets: DataFrame) -> DataFrame:
    """12 counts of the C++ and Java snippets; the line count is on the raw text."""
    text = F.col("clean")
    java = F.col("review_language") == "java"
    alloc = {"cpp": fixed.ALLOC["cpp"], "java": fixed.ALLOC["java"]}
    release = {"cpp": fixed.RELEASE["cpp"], "java": fixed.RELEASE["java"]}
    table = {
        # Without multi-line mode the signature only fits a text that is one signature.
        "num_funcs": has(text, fixed.SIGNATURE).cast("int"),
        "num_loops": hits(text, fixed.LOOP),
        "num_ifs": hits(text, fixed.IF),
        "num_try": hits(text, fixed.TRY),
        "div_zero_hits": hits(text, fixed.DIV_ZERO),
        "infinite_loop_hits": hits(text, fixed.INFINITE_LOOP),
        "input_ops": _per_language({k: fixed.INPUT[k] for k in ("cpp", "java")}, text),
        "sort_ops": _per_language({k: fixed.SORT[k] for k in ("cpp", "java")}, text),
        "alloc_ops": _per_language(alloc, text),
        "release_ops": _per_language(release, text),
        "risky_api_ops": _per_language({k: fixed.RISKY[k] for k in ("cpp", "java")}, text),
    }
    return (
        snippets.filter(F.col("review_language") != "python")
        .withColumn("clean", strip_c_comments(F.col("code")))
        .select("snippet_id", "review_language", _num_lines(),
                *[c.cast("int").alias(n) for n, c in table.items()])
    )


def features_python(snippets: DataFrame, nodes: DataFrame) -> DataFrame:
    """12 counts of the Python snippets; node counts are 0 if the text does not parse."""
    text = F.col("code")
    counted = nodes.groupBy("snippet_id").agg(
        F.count_if(F.col("type") == "FunctionDef").alias("num_funcs"),
        F.count_if(F.col("type").isin("For", "While")).alias("num_loops"),
        F.count_if(F.col("type") == "If").alias("num_ifs"),
        F.count_if(F.col("type") == "Try").alias("num_try"))
    matched = snippets.filter(F.col("review_language") == "python").select(
        "snippet_id", "review_language", _num_lines(),
        hits(text, fixed.DIV_ZERO).alias("div_zero_hits"),
        hits(text, fixed.INFINITE_LOOP).alias("infinite_loop_hits"),
        hits(text, fixed.INPUT["python"]).alias("input_ops"),
        hits(text, fixed.SORT["python"]).alias("sort_ops"),
        hits(text, fixed.ALLOC["python"]).alias("alloc_ops"),
        hits(text, fixed.RELEASE["python"]).alias("release_ops"),
        hits(text, fixed.RISKY["python"]).alias("risky_api_ops"))
    return (
        matched.join(counted, "snippet_id", "left")
        .select("snippet_id", "review_language",
                *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(n) for n in fixed.FEATURES])
    )


def features(snippets: DataFrame, nodes: DataFrame) -> DataFrame:
    return features_c_like(snippets).unionByName(features_python(snippets, nodes))


def features_legacy(feature_rows: DataFrame) -> DataFrame:
    return feature_rows.select("snippet_id", "review_language", *fixed.FEATURES[:5])


def _loc(code: Column) -> Column:
    full = F.size(F.filter(split_lines(code), lambda x: strip(x) != ""))
    return F.greatest(F.lit(1), full).alias("lines_of_code")


def _brace_depth(text: Column) -> Column:
    """Deepest brace nesting; a closer at depth 0 is ignored."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(acc, b):
        depth = F.when(b == "{", acc["depth"] + 1).otherwise(
            F.greatest(F.lit(0), acc["depth"] - 1))
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(r"[{}]"), F.lit(0)), start, step,
                       lambda acc: acc["most"])


def c_like_function_lengths(clean: DataFrame) -> DataFrame:
    """``snippet_id, n_lengths, sum_lengths`` of functions, none inside another.

    A declaration ends where the brace sum is back at its value before it. Each
    line gives one row per value the sum falls to, so the end is the next row at
    the declaration's own value.
    """
    order = Window.partitionBy("snippet_id").orderBy("n")
    later = Window.partitionBy("snippet_id").orderBy(F.col("n").desc())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("raw")
    lines = (
        clean.select("snippet_id", F.posexplode(split_lines(F.col("clean"))).alias("n", "raw"))
        .select("snippet_id", "n",
                # At the line's own start only.
                has(raw, r"\A" + fixed.DECLARATION[1:], "m").alias("is_decl"),
                (occurrences(raw, "{") > 0).alias("opens"),
                (occurrences(raw, "{") - occurrences(raw, "}")).alias("step"))
        .withColumn("sum", F.sum("step").over(upto).cast("int"))
        .withColumn("base", (F.col("sum") - F.col("step")).cast("int"))
        # First line with an opening brace, from this one on.
        .withColumn("first", F.last(F.when(F.col("opens"), F.struct("n", "sum")), True)
                    .over(later.rowsBetween(Window.unboundedPreceding, 0)))
    )
    event = "struct<kind:string,value:int,n:int,start:int,sum:int>"
    nul = F.lit(None)
    none = F.array().cast(f"array<{event}>")
    starts = F.when(F.col("is_decl") & F.col("first").isNotNull(), F.array(F.struct(
        F.lit("start"), F.col("base"), F.col("first.n"), F.col("n"), F.col("first.sum"))
        .cast(event)))
    falls = F.when(F.col("sum") < F.col("base"), F.transform(
        F.sequence("sum", F.col("base") - 1),
        lambda v: F.struct(F.lit("fall"), v, F.col("n"), nul, nul).cast(event)))
    next_fall = F.last(F.when(F.col("kind") == "fall", F.col("n")), True).over(
        Window.partitionBy("snippet_id", "value").orderBy(F.col("n").desc())
        .rangeBetween(Window.unboundedPreceding, -1))
    spans = (
        lines.select("snippet_id", F.explode(
            F.concat(F.coalesce(starts, none), F.coalesce(falls, none))).alias("e"))
        .select("snippet_id", "e.*").withColumn("next_fall", next_fall)
        .filter("kind = 'start'")
        .withColumn("stop", F.when(F.col("sum") <= F.col("value"), F.col("n"))
                    .otherwise(F.col("next_fall")))
        .filter("stop is not null")
        .groupBy("snippet_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop")))
                                   .alias("spans"))
    )
    # Taken in order, a function that starts within the last one taken is passed over.
    zero = F.struct(F.lit(-1).alias("stop"), F.lit(0).alias("n"), F.lit(0).alias("total"))

    def take(acc, s):
        kept = F.struct(s["stop"].alias("stop"), (acc["n"] + 1).alias("n"),
                        (acc["total"] + s["stop"] - s["start"] + 1).alias("total"))
        return F.when(s["start"] > acc["stop"], kept).otherwise(acc)

    taken = F.aggregate("spans", zero, take)
    return spans.select("snippet_id", taken.alias("t")).select(
        "snippet_id", F.col("t.n").alias("n_lengths"), F.col("t.total").alias("sum_lengths"))


def _squeezed(text: Column) -> Column:
    """Blank lines in a row as one line end: no count changes, and a pattern that skips blanks looks at each once."""
    return F.regexp_replace(text, r"\n(?:[^\S\n]*+\n)++", "\n")


def c_like_recursion(clean: DataFrame) -> DataFrame:
    """Snippets in which a declared name is followed by ``(`` more than once."""
    declared = clean.select("snippet_id", F.explode(F.array_distinct(
        groups(_squeezed(F.col("clean")), fixed.DECLARATION, 1, "m"))).alias("name"))
    called = (clean.select("snippet_id", F.explode(groups(F.col("clean"), fixed.CALL, 1))
                           .alias("name"))
              .groupBy("snippet_id", "name").count().filter("count > 1"))
    return called.join(declared, ["snippet_id", "name"], "left_semi").select(
        "snippet_id").distinct()


def _rich(df: DataFrame, lengths: DataFrame, recursive: DataFrame) -> DataFrame:
    mean = F.coalesce(F.col("sum_lengths") / F.col("n_lengths"), F.lit(0.0))
    return (
        df.join(lengths, "snippet_id", "left")
        .join(recursive.withColumn("recursion_detected", F.lit(1)), "snippet_id", "left")
        .withColumn("function_length_avg", round_half_even(mean, 1))
        .select("snippet_id", "review_language", *[
            F.coalesce(F.col(n), F.lit(0)).cast(
                "double" if n == "function_length_avg" else "int").alias(n)
            for n in fixed.RICH_FEATURES])
    )


def rich_c_like(snippets: DataFrame) -> DataFrame:
    """9 richer features of the C++ and Java snippets."""
    source = snippets.filter(F.col("review_language") != "python").withColumn(
        "clean", strip_c_comments(F.col("code")))
    text = F.col("clean")
    counts = source.select(
        "snippet_id", "review_language", _loc(F.col("code")),
        hits(_squeezed(text), fixed.DECLARATION, "m").alias("num_functions"),
        _brace_depth(text).alias("nesting_depth"),
        (hits(text, fixed.BRANCH) + 1).alias("cyclomatic_complexity"),
        hits(text, fixed.LOOP).alias("num_loops"),
        hits(text, fixed.IF).alias("num_conditions"),
        F.lit(0).alias("unused_variables_count"))
    clean = source.select("snippet_id", "clean")
    return _rich(counts, c_like_function_lengths(clean), c_like_recursion(clean))


def rich_python(snippets: DataFrame, nodes: DataFrame) -> DataFrame:
    """9 richer features of the Python snippets."""
    kind = F.col("type")
    is_func = kind.isin("FunctionDef", "AsyncFunctionDef")
    branches = kind.isin("If", "For", "While", "ExceptHandler", "With", "Assert")
    level = F.col("level") + 1
    func = F.try_element_at(F.filter("kids", lambda k: k["field"] == "func"), F.lit(1))
    own_call = (kind == "Call") & (func["type"] == "Name") & F.exists(
        "path", lambda p: (p["type"] == "FunctionDef") & (p["name"] == func["name"]))
    per = nodes.filter("parse_ok").groupBy("snippet_id").agg(
        F.count_if(is_func).alias("num_functions"),
        F.max(F.when(kind.isin(NESTING), level)).alias("nesting_depth"),
        (F.lit(1) + F.count_if(branches)
         + F.coalesce(F.sum(F.when(kind == "BoolOp", F.size("kids") - 1)), F.lit(0)))
        .alias("cyclomatic_complexity"),
        F.count_if(kind.isin("For", "While")).alias("num_loops"),
        F.count_if(kind == "If").alias("num_conditions"),
        F.sum(F.when(is_func, F.greatest(F.lit(1), F.col("end_line") - F.col("line") + 1)))
        .alias("sum_lengths"),
        F.max(own_call).alias("own_call"))
    unused = unused_variable_rows(nodes).groupBy("snippet_id").agg(
        F.count("*").alias("unused_variables_count"))
    counts = (
        snippets.filter(F.col("review_language") == "python")
        .select("snippet_id", "review_language", _loc(F.col("code")))
        .join(per, "snippet_id", "left").join(unused, "snippet_id", "left"))
    mean = F.when(F.col("num_functions") > 0, F.col("sum_lengths") / F.col("num_functions"))
    return (
        counts.withColumn("function_length_avg", round_half_even(mean, 1))
        .withColumn("recursion_detected", F.col("own_call").cast("int"))
        .select("snippet_id", "review_language", *[
            F.coalesce(F.col(n), F.lit(0)).cast(
                "double" if n == "function_length_avg" else "int").alias(n)
            for n in fixed.RICH_FEATURES])
    )


def panel_stats(snippets: DataFrame, nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Lines, functions, loops and rounded risk as the result panel shows them."""
    funcs = nodes.groupBy("snippet_id").agg(
        F.count_if(F.col("type") == "FunctionDef").alias("py_funcs"))
    matched = hits(_squeezed(F.col("code")), fixed.PANEL_FUNCTION, "m")
    return (
        snippets.select("snippet_id", "review_language", line_count(F.col("code")).alias("lines"),
                        F.when(F.col("review_language") != "python", matched).alias("c_funcs"))
        .join(funcs, "snippet_id", "left")
        .join(results.select("snippet_id", "complexity", "confidence"), "snippet_id")
        .select("snippet_id", F.col("lines").cast("int").alias("lines"),
                F.coalesce("c_funcs", "py_funcs", F.lit(0)).cast("int").alias("functions"),
                F.col("complexity").alias("loops"),
                round_half_even(F.col("confidence"), 0).cast("int").alias("risk"))
    )


def numbered(snippets: DataFrame) -> DataFrame:
    """A stored table with a number for each row, so that ids made on the fly are the same for all who read it."""
    return staged(snippets.withColumn("row_no", F.monotonically_increasing_id()), "snippets")


def distinct_snippets(snippets: DataFrame) -> DataFrame:
    """One row per distinct ``(code, review_language)``: the row with the lowest id, once, also if it repeats."""
    return distinct_numbered(numbered(snippets.select("snippet_id", "code", "review_language")))


def distinct_numbered(rows: DataFrame) -> DataFrame:
    """The same for a table with ``row_no``.

    Copies collapse in the map-side hash aggregates over rows without text, so a text that fills a third
    of the table still leaves each task as one row; then the kept rows fetch their texts.
    """
    hashed = rows.select(F.sha2("code", 256).alias("code_hash"), "review_language", "snippet_id", "row_no")
    by_id = hashed.groupBy("code_hash", "review_language", "snippet_id").agg(F.min("row_no").alias("row_no"))
    lowest = (hashed.groupBy(F.col("code_hash").alias("l_hash"), F.col("review_language").alias("l_language"))
              .agg(F.min("snippet_id").alias("l_id")))
    kept = by_id.join(lowest, (F.col("code_hash") == F.col("l_hash")) & F.col("review_language").eqNullSafe(F.col("l_language"))
                      & F.col("snippet_id").eqNullSafe(F.col("l_id")))
    return kept.drop("l_hash", "l_language", "l_id").join(rows.select("row_no", "code"), "row_no").select(
        "code_hash", "review_language", "snippet_id", "code")


def join_by_code(snippets: DataFrame, per_code: DataFrame) -> DataFrame:
    """Give every snippet the columns found for its distinct text."""
    keys = snippets.select("snippet_id", "review_language",
                           F.sha2("code", 256).alias("code_hash"))
    return keys.join(per_code, ["code_hash", "review_language"]).drop("code_hash")
