"""Line table: one row per non-blank line, with the facts the rules need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.lang import resolve_review_language
from reviewlake.functions.text import (
    blank_strings, by_language, contains_any, group, groups, has, occurrences, split_lines,
    strip, strip_c_comments,
)


def with_review_language(snippets: DataFrame) -> DataFrame:
    """Add ``review_language`` from file name, declared language and code."""
    return snippets.withColumn(
        "review_language",
        resolve_review_language(F.col("language"), F.col("filename"), F.col("code")))


def clean_c_like(snippets: DataFrame) -> DataFrame:
    """``snippet_id, review_language, clean`` of the C++ and Java snippets."""
    return snippets.filter(F.col("review_language").isin("cpp", "java")).select(
        "snippet_id", "review_language", strip_c_comments(F.col("code")).alias("clean"))


def explode_lines(df: DataFrame, text: str = "clean", keep: tuple = ()) -> DataFrame:
    """One row per non-blank line: 1-based ``n`` and the stripped ``line``.

    Lines are stripped before they become rows: a filter on rows would strip a line anew for each test in it.
    """
    return (
        df.select("snippet_id", "review_language", *keep, F.posexplode(F.transform(split_lines(F.col(text)), strip)))
        .select("snippet_id", "review_language", *keep, (F.col("pos") + 1).alias("n"), F.col("col").alias("line"))
        .filter(F.col("line") != "")
    )


# rule -> does it need a loop at most six lines back
LINE_RULES = {
    "CJ-1": True, "CJ-2": False, "CJ-3": False, "CJ-4": True, "CJ-5": True, "CJ-6": False,
    "CJ-7": False, "CJ-8": False, "CJ-9": False, "CJ-10": True, "CJ-11": False, "CJ-12": False,
    "CJ-13": False, "CJ-14": True, "CJ-15": False, "CJ-16": False, "CJ-17": False,
}


# Plain text that a match of the pattern must hold.
INPUT_WORDS = {"cpp": ("cin", "getline"), "java": (".next", "readLine")}


def _line_tests() -> dict:
    """Test per rule on one line alone."""
    line, lang = F.col("line"), F.col("review_language")
    cpp, java = lang == "cpp", lang == "java"
    no = F.lit(False)
    blanked = blank_strings(line)
    quoted = contains_any(line, ['"', "'"])
    loop = has(line, fixed.LOOP, words=("for", "while"))
    inputs = {k: (fixed.INPUT[k], w) for k, w in INPUT_WORDS.items()}
    sorts = {k: fixed.SORT[k] for k in ("cpp", "java")}
    return {
        "CJ-1": loop,
        "CJ-2": loop & has(line, fixed.INFINITE_LOOP),
        "CJ-3": has(line, fixed.DIV_ZERO, words=("/",)),
        "CJ-4": by_language(lang, inputs, lambda p: has(line, p[0], words=p[1]), no),
        "CJ-5": by_language(lang, sorts, lambda p: has(line, p, words=("sort",)), no),
        "CJ-6": has(line, fixed.RETURN_NO_SEMICOLON, words=("return",)),
        "CJ-7": line.endswith(")") & has(line, fixed.STATEMENT_NO_SEMICOLON),
        # Blanking keeps what a line begins with.
        "CJ-8": quoted & ~line.startswith("#") & has(blanked, fixed.LITERAL_NO_SEMICOLON),
        "CJ-9": has(line, fixed.ASSIGN_IN_CONDITION, words=("if",)),
        "CJ-10": cpp & has(line, fixed.ENDL, words=("endl",)),
        "CJ-11": cpp & has(line, fixed.POW_TO_INT, words=("pow",)),
        "CJ-12": cpp & has(line, fixed.RISKY["cpp"], words=("gets", "strcpy")),
        "CJ-13": java & line.contains('"') & has(blanked, fixed.JAVA_STRING_EQ),
        "CJ-14": java & F.col("string_word") & line.contains("+")
        & (has(line, fixed.JAVA_CONCAT_ADD) | has(line, fixed.JAVA_CONCAT_SET)),
        "CJ-15": java & has(line, fixed.RISKY["java"], words=("catch",)),
        "CJ-16": cpp & has(line, fixed.CPP_OVERFLOW, words=("int",)),
        "CJ-17": java & line.contains("*") & has(line, fixed.JAVA_OVERFLOW, words=("int",)),
    }


def line_facts(clean: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """All facts of a line in one pass over the text; the text itself is not kept.

    What goes into a shuffle later is this narrow row, never the code. With ``rules`` a line is tested for these line
    rules only, and for loops if one of them looks for loops before the line.
    """
    line, lang = F.col("line"), F.col("review_language")
    lines = explode_lines(
        clean.withColumn("string_word", has(F.col("clean"), fixed.JAVA_STRING_WORD))
        .withColumn("switch_word", has(F.col("clean"), fixed.SWITCH_OPEN)),
        keep=("string_word", "switch_word"))
    tests = _line_tests()
    asked = set(rules or tests)
    if any(LINE_RULES[r] for r in asked):
        asked.add("CJ-1")
    none = F.array().cast("array<string>")
    returns, name = group(line, fixed.SIGNATURE, 1), group(line, fixed.SIGNATURE, 2)
    indexed = line.contains("[")

    def first(patterns: dict, idx: int) -> Column:
        found = by_language(lang, patterns, lambda p: group(line, p, idx), F.lit(""))
        return F.when(indexed, found).otherwise("")

    def every(pattern: str, idx: int, word: str) -> Column:
        return F.when(line.contains(word), groups(line, pattern, idx)).otherwise(none)

    return lines.select(
        "snippet_id", "review_language", "n",
        tests["CJ-1"].alias("has_loop"),
        F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items() if r in asked]),
                 lambda r: r.isNotNull()).alias("tests"),
        occurrences(line, "{").alias("opens"),
        occurrences(line, "}").alias("closes"),
        (F.length(line) - F.length(F.ltrim(line, F.lit("}")))).alias("leading"),
        F.when(has(line, fixed.SIGNATURE, words=("(",)),
               F.when(returns != "void", name)).alias("func_name"),
        # The only brace a signature can hold is at its end.
        line.endswith("{").alias("func_brace"),
        has(line, fixed.RETURN_WORD, words=("return",)).alias("is_return"),
        has(line, fixed.GUARD_WORD, words=("if", "switch")).alias("is_guard"),
        F.array_distinct(every(fixed.CALL, 1, "(")).alias("calls"),
        "switch_word", has(line, fixed.SWITCH_OPEN, words=("switch",)).alias("is_switch"),
        has(line, fixed.SWITCH_CASE, words=("case", "default")).alias("is_case"),
        has(line, fixed.SWITCH_BREAK, words=("break", "return", "throw", "continue", "goto"))
        .alias("is_break"),
        F.struct(first(fixed.ARRAY_INIT, 1).alias("name"),
                 first(fixed.ARRAY_INIT, 2).alias("items")).alias("init"),
        F.struct(first(fixed.ARRAY_SIZE, 1).alias("name"),
                 first(fixed.ARRAY_SIZE, 2).alias("size")).alias("sized"),
        F.arrays_zip(every(fixed.ARRAY_ACCESS, 1, "[").alias("name"),
                     every(fixed.ARRAY_ACCESS, 2, "[").alias("idx")).alias("accesses"),
    )
