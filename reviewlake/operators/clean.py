"""Corpus cleaning, weak labels and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.lang import normalize_language, resolve_row_language
from reviewlake.functions.text import has, strip
from reviewlake.operators.nodes import parse_check


def clean_dataset(corpus: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Keep texts of 8 characters or more in an allowed language; Python must parse."""
    allowed = allowed or fixed.SUPPORTED
    names = [fixed.ALIASES.get(a.strip().lower(), a.strip().lower()) for a in allowed if a]
    rows = (
        corpus.withColumn("code", F.coalesce("code", F.lit("")))
        .filter(F.length(strip(F.col("code"))) >= 8)
        .withColumn("review_language", resolve_row_language(F.col("language"), F.col("path")))
        .filter(F.col("review_language").isin(names))
    )
    # The parser sees the Python texts only; a filter in place, so no text is shuffled.
    python = F.when(F.col("review_language") == "python", F.col("code"))
    return rows.filter(parse_check(python)["parse_ok"])


def language_distribution(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("review_language").agg(F.count("*").alias("n"))


def label_distribution(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("review_language", "bug_risk").agg(F.count("*").alias("n"))


def _points(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def bug_risk_label(code: Column, language: Column) -> Column:
    """1 if the risk hints of a text add up to 2 points or more."""
    lang = F.coalesce(normalize_language(language), F.lit("python"))
    packed = F.replace(code, F.lit(" "), F.lit(""))
    score = (
        _points(code.contains("TODO") | code.contains("FIXME"), 1)
        + _points(packed.contains("while(true)") | packed.contains("for(;;)"), 2)
        + _points(has(code, fixed.DIV_ZERO), 2)
    )
    python = (
        _points(~code.contains("try:") | ~code.contains("except"), 1)
        + _points(has(code, r"==\s*None"), 1)
        + _points(code.contains("eval(") | code.contains("exec("), 2)
    )
    cpp = (
        _points(has(code, r"\b(?:malloc|calloc|realloc)\s*\(") & ~code.contains("free("), 2)
        + _points(code.contains("new ") & ~code.contains("delete "), 2)
        + _points(has(code, fixed.RISKY["cpp"]), 2)
    )
    java = (
        _points(has(code, r"\bnew\s+(?:Scanner|BufferedReader)\b") & ~code.contains(".close("), 2)
        + _points(has(code, r"\bcatch\s*\(\s*Exception"), 1)
    )
    extra = (F.when(lang == "python", python).when(lang == "cpp", cpp).when(lang == "java", java)
             .otherwise(0))
    return F.when(score + extra >= 2, 1).otherwise(0)


def with_bug_risk(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumn("bug_risk",
                              bug_risk_label(F.col("code"), F.col("review_language")))
