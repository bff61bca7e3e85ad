"""Risk, ranking, severities and explanations of issues."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.explanations import DEFAULT_TEMPLATE, TEMPLATES
from reviewlake.functions.numbers import round_half_even, round_half_up
from reviewlake.functions.text import contains_any, issue_fix, issue_name, lookup


def distinct_issues(issues: DataFrame) -> DataFrame:
    """One row per ``(snippet, name, line, fix)``, with ``place``: its first in report order."""
    # One number keeps the aggregate a hash aggregate; a struct would make it sort.
    place = (F.col("phase") * F.lit(Decimal(10 ** 25)) + F.col("o1") * F.lit(Decimal(10 ** 12))
             + F.col("o2"))
    return issues.groupBy("snippet_id", "name", "line", "fix").agg(
        F.min(place.cast("decimal(38,0)")).alias("place"))


def complexity_issues(features: DataFrame) -> DataFrame:
    """CJ-28: three loops or more, in any language."""
    return features.filter("num_loops >= 3").select(
        "snippet_id", F.lit("CJ-28").alias("rule"), issue_name("CJ-28").alias("name"),
        F.lit(0).alias("line"), issue_fix("CJ-28").alias("fix"), F.lit(99).alias("phase"),
        F.lit(0).cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2"))


def complexity(num_loops: Column) -> Column:
    return F.greatest(F.lit(1), num_loops)


def risk_score(n_issues: Column, loops: Column, conditions: Column,
               probability: Column | None = None, threshold: Column | None = None) -> Column:
    """Risk 0-100. The probability counts only between the two shortcuts."""
    many = F.least(F.lit(95.0), (n_issues * 18 + loops * 10 + conditions * 4).cast("double"))
    simple = (loops * 8 + conditions * 3).cast("double")
    plain = F.least(F.lit(95.0), (n_issues * 16 + loops * 10 + conditions * 4).cast("double"))
    if probability is not None:
        t = F.coalesce(threshold, F.lit(0.5)) if threshold is not None else F.lit(0.5)
        t = F.least(F.greatest(t, F.lit(0.05)), F.lit(0.95))
        scaled = F.when(probability >= t,
                        F.lit(50.0) + F.lit(50.0) * (probability - t) / (F.lit(1.0) - t)
                        ).otherwise(F.lit(50.0) * (probability / t))
        scaled = F.least(F.lit(100.0), scaled + n_issues * 15.0)
        scaled = F.least(F.lit(100.0), F.greatest(F.lit(0.0), scaled))
        plain = F.when(probability.isNotNull(), round_half_even(scaled, 2)).otherwise(plain)
    return (F.when(n_issues >= 2, many)
            .when((n_issues == 0) & (loops <= 1) & (conditions <= 2), simple)
            .otherwise(plain))


def needs_model(n_issues: Column, loops: Column, conditions: Column) -> Column:
    """Is the model's probability used at all?"""
    return (n_issues < 2) & ~((n_issues == 0) & (loops <= 1) & (conditions <= 2))


def rank_of(name: Column) -> Column:
    return (F.when(name.isin(fixed.RANK_0), 0).when(name.isin(fixed.RANK_1), 1).otherwise(2))


def rank_issues(issues: DataFrame) -> DataFrame:
    """``position``: 1-based place by (rank, line), ties in report order."""
    ranked = issues.withColumn("rank", rank_of(F.col("name")))
    order = Window.partitionBy("snippet_id").orderBy("rank", "line", "place", "fix")
    return ranked.withColumn("position", F.row_number().over(order))


def severity_app(name: Column) -> Column:
    low = F.lower(name)
    return (F.when(contains_any(low, fixed.APP_CRITICAL), "critical")
            .when(contains_any(low, fixed.APP_WARNING), "warning").otherwise("tip"))


def severity_panel(name: Column) -> Column:
    low = F.lower(name)
    return (F.when(contains_any(low, fixed.PANEL_CRITICAL), "critical")
            .when(contains_any(low, fixed.PANEL_WARNING), "warning").otherwise("tip"))


def template_table(spark: SparkSession) -> DataFrame:
    """The explanation table: a fixed, small number of rows."""
    rows = [(i, *t) for i, t in enumerate(TEMPLATES)]
    return spark.createDataFrame(
        rows, "ord int, template string, severity_hint string, explanation string, "
              "template_fix string")


def template_order(name: Column) -> Column:
    """Row of the explanation table: the exact name, else the first whose 20 letters fit."""
    exact = lookup(name, {t[0]: i for i, t in enumerate(TEMPLATES)})
    fuzzy = None
    for i, template in enumerate(TEMPLATES):
        fits = F.lower(name).startswith(template[0].lower()[:20])
        fuzzy = F.when(fits, i) if fuzzy is None else fuzzy.when(fits, i)
    return F.coalesce(exact, fuzzy)


def template_lookup(issues: DataFrame) -> DataFrame:
    """Add ``severity_hint, explanation, template_fix`` to rows with ``name``."""
    default = dict(zip(("severity_hint", "explanation", "template_fix"), DEFAULT_TEMPLATE))
    # The explanation table has a fixed number of rows.
    joined = issues.withColumn("ord", template_order(F.col("name"))).join(
        F.broadcast(template_table(issues.sparkSession)), "ord", "left")
    for column, value in default.items():
        joined = joined.withColumn(column, F.coalesce(column, F.lit(value)))
    return joined.drop("ord", "template")


def issue_severity(name: Column, confidence: Column) -> Column:
    """LOW .. CRITICAL by exact name; a risk of 80 or more raises LOW and MEDIUM a step."""
    by_level: dict[str, list[str]] = {}
    for template, level, _, _ in TEMPLATES:
        by_level.setdefault(level, []).append(template)
    base = F.lit(DEFAULT_TEMPLATE[0])
    for level, names in by_level.items():
        base = F.when(name.isin(names), level).otherwise(base)
    raised = (F.when((confidence >= 80) & (base == "MEDIUM"), "HIGH")
              .when((confidence >= 80) & (base == "LOW"), "MEDIUM").otherwise(base))
    return F.when(name.contains("Compiler Error"), "CRITICAL").otherwise(raised)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.SEVERITY_ORDER)), severity).cast("int") - 1


def worst_severity(issue_names: Column, confidence: Column) -> Column:
    """Worst severity over an array of names; LOW when empty."""
    ranks = F.transform(issue_names, lambda n: severity_rank(issue_severity(n, confidence)))
    worst = F.coalesce(F.array_max(ranks), F.lit(0))
    return F.element_at(F.array(*map(F.lit, fixed.SEVERITY_ORDER)), worst + 1)


def app_score(confidence: Column, n_issues: Column, syntax_error: Column) -> Column:
    base = F.greatest(F.lit(0), F.lit(100) - confidence.cast("int") - n_issues * 8)
    return F.when(syntax_error, 20).otherwise(
        F.greatest(F.lit(10), F.least(F.lit(99), base))).cast("int")


def panel_score(confidence: Column, syntax_error: Column) -> Column:
    return F.when(syntax_error, 10).otherwise(
        F.greatest(F.lit(0), round_half_up(F.lit(100) - confidence))).cast("int")


def health_label(confidence: Column, n_issues: Column) -> Column:
    return (F.when((confidence > 70) | (n_issues >= 3), "critical")
            .when((confidence > 35) | (n_issues >= 1), "risky").otherwise("healthy"))


def app_band(score: Column) -> Column:
    return F.when(score >= 75, "green").when(score >= 50, "orange").otherwise("red")


def panel_band(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "orange").otherwise("red")


def panel_issues(results: DataFrame) -> DataFrame:
    """Issues as the panel lists them: the syntax error first, then the ranked issues."""
    entry = "array<struct<name:string,line:int,fix:string,severity:string>>"
    error = F.when(F.col("syntax_error"), F.array(F.struct(
        F.lit("Syntax Error").alias("name"), F.coalesce("error_line", F.lit(0)).alias("line"),
        F.col("error_msg").alias("fix"), F.lit("critical").alias("severity")))).otherwise(
            F.array().cast(entry))
    rest = F.transform("issues", lambda i: F.struct(
        i["name"].alias("name"), i["line"].alias("line"), i["fix"].alias("fix"),
        severity_panel(i["name"]).alias("severity")))
    return (results.select("snippet_id", F.posexplode(F.concat(error.cast(entry),
                                                               rest.cast(entry))))
            .select("snippet_id", (F.col("pos") + 1).alias("position"), "col.*"))


def primary_issue(issues: Column) -> Column:
    return F.coalesce(F.try_element_at(issues, F.lit(1))["name"], F.lit("clean"))
