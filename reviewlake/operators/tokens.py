"""Bracket check for C++ and Java over a token table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Comments, strings and character literals (closed, or running to the end),
# brackets and line ends. Possessive repeats keep long literals off the stack.
TOKEN = (r'//[^\n]*+'
         r'|/\*[\s\S]*?(?:\*/|\z)'
         r'|"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?\z)'
         r"|'(?:[^'\\]++|\\[\s\S])*+(?:'|\\?\z)"
         r'|[()\[\]{}]|\n')
CLOSED_LITERAL = r"""\A(?:"(?:[^"\\]++|\\[\s\S])*+"|'(?:[^'\\]++|\\[\s\S])*+')\z"""
COMMENT_OR_LITERAL = (r'//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)'
                      r'|"(?:[^"\\]++|\\[\s\S])*+"'
                      r"|'(?:[^'\\]++|\\[\s\S])*+'")
NESTING_PASSES = 12


def _may_be_faulty(code: Column) -> Column:
    """False only for texts that are surely balanced.

    What is left of the brackets after taking out pairs, innermost first. Deeper
    nesting than the passes reach, and any open quote, leaves something over.
    """
    rest = F.regexp_replace(F.regexp_replace(code, COMMENT_OR_LITERAL, ""),
                            r"""[^()\[\]{}"']++""", "")
    for _ in range(NESTING_PASSES):
        rest = F.regexp_replace(rest, r"\(\)|\[\]|\{\}", "")
    return rest != ""


def bracket_tokens(snippets: DataFrame) -> DataFrame:
    """``snippet_id, i, kind, line``: brackets and open literals, in order.

    ``kind`` is the bracket, or the quote of a literal that is never closed.
    """
    tokens = snippets.filter(F.col("review_language").isin("cpp", "java")).select(
        "snippet_id", F.posexplode(F.regexp_extract_all("code", F.lit(TOKEN), F.lit(0))))
    text = F.col("col")
    first = F.substring(text, 1, 1)
    is_open = first.isin('"', "'") & ~text.rlike(CLOSED_LITERAL)
    return tokens.select(
        "snippet_id", F.col("pos").alias("i"),
        F.when(first.isin("(", "[", "{", ")", "]", "}") | is_open, first).alias("kind"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("breaks"),
    )


def c_like_syntax(snippets: DataFrame) -> DataFrame:
    """First syntax error per snippet: ``snippet_id, error_line, error_msg``.

    An unmatched closer comes first, then an open literal, then the innermost
    open bracket. Only texts that may be faulty are cut into tokens and shuffled.
    """
    snippets = snippets.filter(F.col("review_language").isin("cpp", "java")).filter(
        _may_be_faulty(F.col("code")))
    order = Window.partitionBy("snippet_id").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tokens = (
        bracket_tokens(snippets)
        .withColumn("line", F.coalesce(F.sum("breaks").over(before), F.lit(0)) + 1)
        .filter("kind is not null")
    )
    opens = F.col("kind").isin("(", "[", "{")
    closes = F.col("kind").isin(")", "]", "}")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    # Opener and closer of a pair have the same level; the partner of a closer
    # is the bracket before it at that level.
    leveled = (
        tokens.withColumn("depth", F.sum(step).over(upto))
        .withColumn("level", F.col("depth") + F.when(closes, 1).otherwise(0))
    )
    is_bracket = opens | closes
    paired = leveled.withColumn("partner", F.lag("kind").over(
        Window.partitionBy("snippet_id", "level", is_bracket).orderBy("i")))
    matches = F.concat("partner", "kind").isin("()", "[]", "{}")
    bad = closes & ((F.col("depth") < 0) | ~F.coalesce(matches, F.lit(False)))
    quote = F.col("kind").isin('"', "'")
    token = F.struct("i", "kind", "line")
    # Of the openers nothing closes, the innermost is the last one at the final depth.
    final = F.max(F.struct("i", "depth")).over(Window.partitionBy("snippet_id"))["depth"]
    per = paired.withColumn("final", final).groupBy("snippet_id").agg(
        F.min(F.when(bad, token)).alias("bad"),
        F.max(F.when(quote, token)).alias("quote"),
        F.max(F.when(opens & (F.col("level") == F.col("final")), token)).alias("open"),
        F.max("final").alias("final"),
    )
    unclosed = F.when(F.col("final") > 0, F.col("open"))
    return (
        per.withColumn("open", unclosed).select(
            "snippet_id",
            F.coalesce("bad.line", "quote.line", "open.line").cast("int").alias("error_line"),
            F.when(F.col("bad").isNotNull(),
                   F.concat(F.lit("Unmatched '"), "bad.kind", F.lit("' in code block")))
            .when(F.col("quote.kind") == '"', "Unclosed string literal")
            .when(F.col("quote.kind") == "'", "Unclosed character literal")
            .otherwise(F.concat(F.lit("Unclosed '"), "open.kind", F.lit("' in code block")))
            .alias("error_msg"))
        .filter("error_line is not null")
    )
