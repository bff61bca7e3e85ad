"""Threshold choice and metrics on scored rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = [float(c) for c in np.linspace(0.05, 0.95, 181)]
SCORE_BUCKETS = 4096


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _f_beta(precision: Column, recall: Column, beta: Column) -> Column:
    square = beta * beta
    return (F.lit(1.0) + square) * precision * recall / F.greatest(
        square * precision + recall, F.lit(1e-12))


def _cuts_reached(p: Column) -> Column:
    """How many cuts are not above ``p``: an estimate, put right by the cuts' own values."""
    cuts = F.array(*map(F.lit, CUTS))
    guess = F.least(F.greatest(F.floor((p - 0.05) / 0.005) + 1, F.lit(0)), F.lit(181)).cast("int")
    at = F.try_element_at(cuts, F.nullif(guess, F.lit(0)))
    after = F.try_element_at(cuts, guess + 1)
    return F.when(p < at, guess - 1).when(p >= after, guess + 1).otherwise(guess)


def cut_table(scored: DataFrame) -> DataFrame:
    """Per language and cut: counts at ``probability >= cut``.

    Scores fall into 182 groups between the cuts before anything is shuffled;
    the counts at a cut are sums over the groups above it.
    """
    groups = scored.groupBy("review_language", _cuts_reached(F.col("probability")).alias("k")).agg(
        F.count("*").alias("n"), F.sum("label").alias("pos"))
    totals = groups.groupBy("review_language").agg(F.sum("pos").alias("all_pos"))
    cuts = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(c).alias("cut"))
                               for i, c in enumerate(CUTS)])).alias("c")
    grid = totals.select("review_language", "all_pos", cuts).select(
        "review_language", "all_pos", "c.*")
    above = Window.partitionBy("review_language").orderBy(F.col("k").desc())
    joined = grid.join(groups, ["review_language", "k"], "left")
    return joined.select(
        "review_language", "cut", "all_pos",
        F.sum(F.coalesce("n", F.lit(0))).over(above).alias("predicted"),
        F.sum(F.coalesce("pos", F.lit(0))).over(above).alias("tp"))


def threshold_sweep(scored: DataFrame, betas: dict[str, float],
                    min_recalls: dict[str, float]) -> DataFrame:
    """Best decision threshold per language of ``review_language, label, probability``."""
    language = F.col("review_language")
    beta, floor = F.lit(1.0), F.lit(None).cast("double")
    for lang, value in betas.items():
        beta = F.when(language == lang, F.lit(max(0.1, value))).otherwise(beta)
    for lang, value in min_recalls.items():
        floor = F.when(language == lang, F.lit(value)).otherwise(floor)
    tp, predicted, all_pos = F.col("tp"), F.col("predicted"), F.col("all_pos")
    rows = (
        cut_table(scored)
        .withColumn("precision", _ratio(tp, predicted))
        .withColumn("recall", _ratio(tp, all_pos))
        .withColumn("f1", _ratio(tp * 2.0, predicted + all_pos))
        .withColumn("fbeta", _f_beta(F.col("precision"), F.col("recall"), beta))
        .withColumn("qualifies", F.coalesce(F.col("recall") >= floor, F.lit(False)))
    )
    cols = F.struct("cut", "f1", "fbeta", "precision", "recall")
    used = predicted > 0
    best = rows.groupBy("review_language").agg(
        F.max_by(F.when(used, cols), F.when(used, F.struct("fbeta", "recall", (-F.col("cut")))))
        .alias("best"),
        F.max_by(F.when(used, cols), F.when(used & F.col("qualifies"),
                                            F.struct("f1", "precision", (-F.col("cut")))))
        .alias("floored"))
    pick = F.coalesce("floored", "best")
    # Nothing is ever predicted below the lowest cut: the default threshold, no hits.
    return best.select(
        "review_language", F.coalesce(pick["cut"], F.lit(0.5)).alias("threshold"),
        *[F.coalesce(pick[c], F.lit(0.0)).alias(c) for c in ("f1", "fbeta", "precision",
                                                              "recall")])


def rank_auc(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Exact area under the ROC curve by rank sums, ties half.

    Equal scores collapse first. Ranks run inside score buckets and bucket totals
    carry them on, so no group's scores come together in one task.
    """
    per_score = scored.groupBy(*groups, "probability").agg(
        F.sum("label").alias("pos"), (F.count("*") - F.sum("label")).alias("neg")
    ).withColumn("bucket", F.floor(F.col("probability") * SCORE_BUCKETS))
    buckets = per_score.groupBy(*groups, "bucket").agg(F.sum("neg").alias("bucket_neg"))
    lower = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = buckets.select(*groups, "bucket", F.coalesce(
        F.sum("bucket_neg").over(lower), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*groups, "bucket").orderBy("probability").rowsBetween(
        Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.col("below") + F.col("inner") + F.col("neg") / 2)
    total = F.sum("pos") * F.sum("neg")
    return (
        per_score.withColumn("inner", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
        .join(offsets, [*groups, "bucket"])
        .groupBy(*groups)
        .agg(F.when(total > 0, F.sum(won) / total).otherwise(0.5).alias("roc_auc"))
    )


def confusion(predicted: Column, label: Column) -> list[Column]:
    return [F.count_if((predicted == 1) & (label == 1)).alias("tp"),
            F.count_if((predicted == 1) & (label == 0)).alias("fp"),
            F.count_if((predicted == 0) & (label == 1)).alias("fn"),
            F.count_if((predicted == 0) & (label == 0)).alias("tn")]


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tp * 2.0, tp * 2 + fp + fn)


def binary_metrics(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Per group of ``label, probability, threshold``: metrics at the threshold and at 0.5."""
    at = (F.col("probability") >= F.col("threshold")).cast("int")
    half = (F.col("probability") >= 0.5).cast("int")
    label = F.col("label")
    counts = scored.groupBy(*groups).agg(
        *confusion(at, label),
        F.count_if((half == 1) & (label == 1)).alias("tp_h"),
        F.count_if((half == 1) & (label == 0)).alias("fp_h"),
        F.count_if((half == 0) & (label == 1)).alias("fn_h"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall, f1 = _prf(tp, fp, fn)
    default_f1 = _prf(F.col("tp_h"), F.col("fp_h"), F.col("fn_h"))[2]
    return (
        counts.select(*groups, precision.alias("precision"), recall.alias("recall"),
                      f1.alias("f1"), default_f1.alias("f1_default_threshold"),
                      (tp + fp + fn + F.col("tn")).alias("n_samples"))
        .join(rank_auc(scored, groups), groups)
    )


def class_report(predictions: DataFrame, label: str, predicted: str,
                 groups: tuple = ()) -> DataFrame:
    """Per class: precision, recall, F1 and support, from one small count table."""
    pairs = predictions.groupBy(*groups, label, predicted).agg(F.count("*").alias("n"))
    sides = pairs.select(*groups, F.explode(F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long")
                 .alias("claimed"), F.when(F.col(label) == F.col(predicted), F.col("n"))
                 .otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")),
    )).alias("s")).select(*groups, "s.*")
    per = sides.groupBy(*groups, "class").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"),
        F.sum("hit").alias("hit"))
    hit, support, claimed = F.col("hit"), F.col("support"), F.col("claimed")
    return per.select(*groups, "class", _ratio(hit, claimed).alias("precision"),
                      _ratio(hit, support).alias("recall"),
                      _ratio(hit * 2.0, claimed + support).alias("f1"), "support")


def report_summary(report: DataFrame, groups: tuple = ()) -> DataFrame:
    """Accuracy, and the plain and support-weighted means of a class report."""
    n = F.sum("support")
    means = {c: (F.avg(c), F.sum(F.col(c) * F.col("support")) / n)
             for c in ("precision", "recall", "f1")}

    def row(name, values):
        return F.struct(F.lit(name).alias("class"), *[v.alias(c) for c, v in values.items()],
                        F.col("total").alias("support"))

    per = report.groupBy(*groups).agg(
        n.alias("total"), *[v.alias(f"{c}_{i}") for c, m in means.items() for i, v in enumerate(m)])
    # Each row is in its class as often as its class is hit: accuracy is weighted recall.
    rows = F.array(
        row("accuracy", {c: F.col("recall_1") for c in means}),
        row("macro avg", {c: F.col(f"{c}_0") for c in means}),
        row("weighted avg", {c: F.col(f"{c}_1") for c in means}))
    return per.select(*groups, F.inline(rows))


def predict_flag(n_issues: Column, confidence: Column) -> Column:
    return F.when((n_issues > 0) | (confidence > 40), 1).otherwise(0)


DIGITS = 4


def _digits(value: Column) -> list[Column]:
    """A double as four whole numbers whose order, one after the other, is the order of doubles.

    Sign and power of two come first, then 18, 17 and 17 bits of what is above that power. All steps are exact, and the logarithm
    is at least monotonic, so a power that it rounds up only makes the next number negative.
    """
    size = F.abs(value)
    sign = F.when(value < 0, -1).otherwise(1)
    power = F.floor(F.log2(size))
    above = size / F.pow(F.lit(2.0), power) - 1
    second = above * (1 << 18)
    third = (second - F.floor(second)) * (1 << 17)
    fourth = (third - F.floor(third)) * (1 << 17)
    infinite, zero = size == float("inf"), size == 0
    first = F.when(F.isnan(value), 9999).when(infinite, sign * 9000).when(zero, 0).otherwise(sign * (power + 2000))
    plain = ~(F.isnan(value) | infinite | zero)
    return [first.cast("long"), *[F.when(plain, sign * F.floor(x)).otherwise(0).cast("long") for x in (second, third, fourth)]]


def exact_percentile(rows: DataFrame, groups: list[str], value: str, share: float, name: str) -> DataFrame:
    """``groups, name``: the interpolated percentile of each group, by radix selection.

    Rows are counted by the leading digits of their values; only those in the one bucket that holds the wanted rank are counted by
    the next digits. A task holds counts of digits, never a group's values. Null values are left out, and so are groups without others;
    NaN is the largest value.
    """
    names = [f"_d{i}" for i in range(DIGITS)]
    given = rows.select(*groups, F.col(value).cast("double").alias("_v"))
    dealt = given.filter("_v is not null").select("*", *[d.alias(n) for d, n in zip(_digits(F.col("_v")), names)])
    sizes = dealt.groupBy(*groups).agg(F.count("*").alias("_n"))
    place = (F.col("_n") - 1) * F.lit(share)
    wanted = sizes.select(*groups, F.explode(F.array(F.struct(F.lit("low").alias("_end"), F.floor(place).alias("_rank")),
                                                     F.struct(F.lit("high").alias("_end"), F.ceil(place).alias("_rank"))))
                          .alias("_w")).select(*groups, "_w.*")
    for i, digit in enumerate(names):
        known = [*groups, *names[:i]]
        right = wanted.select(*[F.col(k).alias(f"_k_{k}") for k in known], "_end", "_rank")
        same = F.lit(True)
        for k in known:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        counts = (dealt if known else dealt.withColumn("_one", F.lit(1))).join(right, same).groupBy(*known, "_end", "_rank", digit).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_v"))
        up_to = Window.partitionBy(*groups, "_end").orderBy(digit)
        through = F.sum("_c").over(up_to)
        wanted = (counts.withColumn("_through", through).filter((F.col("_through") > F.col("_rank"))
                                                                & (F.col("_through") - F.col("_c") <= F.col("_rank")))
                  .withColumn("_rank", F.col("_rank") - F.col("_through") + F.col("_c")).select(*known, digit, "_end", "_rank", "_v"))
    ends = wanted.groupBy(*groups).agg(F.max(F.when(F.col("_end") == "low", F.col("_v"))).alias("_low"),
                                       F.max(F.when(F.col("_end") == "high", F.col("_v"))).alias("_high"))
    at, low, high = (F.col("_n") - 1) * F.lit(share), F.col("_low"), F.col("_high")
    between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
    found = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_n")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return ends.join(found, same).select(*groups, F.when(low == high, low).otherwise(between).alias(name))


def eval_metrics(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Metrics of ``label, predicted, latency_ms`` per group."""
    counts = rows.groupBy(*groups).agg(
        *confusion(F.col("predicted"), F.col("label")),
        F.count_if(F.col("label") == 0).alias("negatives"), F.count("*").alias("n_samples"),
        F.avg("latency_ms").alias("avg_latency_ms"))
    late = exact_percentile(rows, groups, "latency_ms", 0.95, "p95_latency_ms")
    counts = counts.join(late, groups, "left")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall, f1 = _prf(tp, fp, fn)
    return counts.select(
        *groups, precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        (fp / F.greatest(F.lit(1), F.col("negatives"))).alias("false_positive_rate"),
        "avg_latency_ms", "p95_latency_ms", F.col("n_samples").cast("double").alias("n_samples"))


METRICS = ["precision", "recall", "f1", "false_positive_rate", "avg_latency_ms", "p95_latency_ms",
           "n_samples"]


def eval_compare(rows: DataFrame, modes: list[str]) -> DataFrame:
    """Metrics by row, modes side by side; ``rows`` carries ``mode``."""
    per_mode = eval_metrics(rows, ["mode"])
    long = per_mode.select("mode", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m"))
    return (long.select("mode", "m.*").groupBy("metric").pivot("mode", modes)
            .agg(F.first("value")))


def synthetic_labels(samples: DataFrame, issues: DataFrame,
                     limit: int | None = None) -> DataFrame:
    """Label 1 where the rules find an issue, for all samples or the first ``limit`` by id."""
    first = samples if limit is None else samples.orderBy("snippet_id").limit(limit)
    flagged = issues.select("snippet_id").distinct().withColumn("label", F.lit(1))
    return first.join(flagged, "snippet_id", "left").withColumn(
        "label", F.coalesce("label", F.lit(0)))
