"""Whole flows: training data from a corpus, and rules against rules with a model."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.operators import metrics, models
from reviewlake.operators.clean import clean_dataset, with_bug_risk
from reviewlake.operators.features import features
from reviewlake.operators.nodes import node_table
from reviewlake.plans.review import SnippetTables, review
from reviewlake.sources import corpus as readers
from reviewlake.sources.stage import staged


def build_dataset(corpus: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Cleaned, labelled snippets as feature rows.

    ``corpus`` needs ``snippet_id, code, path, language``.
    """
    cleaned = staged(with_bug_risk(clean_dataset(corpus, allowed)).select(
        "snippet_id", "code", "review_language", "bug_risk"), "cleaned")
    rows = features(cleaned, node_table(cleaned))
    labels = cleaned.select("snippet_id", "bug_risk")
    return rows.join(labels, "snippet_id").select(
        "snippet_id", "review_language", *fixed.FEATURES, "bug_risk")


def as_python(samples: DataFrame) -> DataFrame:
    return samples.withColumn("language", F.lit("python")).withColumn("filename", F.lit(None).cast("string"))


def unlabeled_samples(spark: SparkSession, paths: list[str], max_samples: int | None = None) -> DataFrame:
    """``snippet_id, code`` of the samples in JSONL files, in the order of the files up to ``max_samples``."""
    rows = readers.read_unlabeled(spark, paths)
    if max_samples is not None:
        rows = readers.take_first(rows, max_samples)
    return staged(rows.select(F.monotonically_increasing_id().alias("snippet_id"), "code"), "samples")


def samples_of_files(spark: SparkSession, paths: list[str], max_samples: int | None = 500) -> DataFrame:
    """``snippet_id, code, label``: the labelled samples of the files, or all of them where none has a label.

    Without labels a sample counts as risky if the rules find an issue in it. Such samples bring ``predicted, latency_ms`` of
    that review along, so ``evaluate`` need not review them by the rules again.
    """
    labeled = staged(readers.read_labeled(spark, paths, max_samples).select(
        F.monotonically_increasing_id().alias("snippet_id"), "code", "label"), "labeled")
    if not labeled.isEmpty():
        return labeled
    samples = unlabeled_samples(spark, paths, max_samples)
    flagged = flags(samples)
    labels = metrics.synthetic_labels(flagged, flagged.filter("found")).drop("found")
    return staged(samples.join(labels, "snippet_id"), "synthetic")


def classifier_rows(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The training rows of the issue and of the severity classifier from samples without labels."""
    samples = unlabeled_samples(spark, paths)
    tables = SnippetTables(samples.withColumn("review_language", F.lit("python")))
    results = staged(tables.results(), "results")
    return models.issue_dataset(tables.features, results), models.severity_dataset(tables.features, results)


def train_classifiers(spark: SparkSession, paths: list[str], folder: str, issue: dict | None = None,
                      severity: dict | None = None) -> dict[str, DataFrame]:
    """Train both classifiers on the samples of the files, save them below ``folder``, and return their class reports."""
    issue_rows, severity_rows = classifier_rows(spark, paths)
    issue_model, issue_report = models.train_issue_classifier(issue_rows, **(issue or {}))
    severity_model, severity_report = models.train_severity_classifier(severity_rows, **(severity or {}))
    issue_model.save(f"{folder}/issue")
    severity_model.save(f"{folder}/severity")
    return {"issue": issue_report, "severity": severity_report}


def flags(samples: DataFrame, package: tuple[dict, dict] | None = None) -> DataFrame:
    """``snippet_id, found, predicted, latency_ms`` of Python samples: is there an issue, and is the sample taken for risky.

    Snippets are reviewed together, so each one's latency is its share of the time.
    """
    start = time.perf_counter()
    results = staged(review(as_python(samples), package).select(
        "snippet_id", (F.size("issues") > 0).alias("found"),
        metrics.predict_flag(F.size("issues"), F.col("confidence")).alias("predicted")), "predicted")
    share = 1000 * (time.perf_counter() - start) / max(1, results.count())
    return results.withColumn("latency_ms", F.lit(share))


def predict(samples: DataFrame, package: tuple[dict, dict] | None = None) -> DataFrame:
    """``snippet_id, label, predicted, latency_ms`` of Python samples."""
    return samples.select("snippet_id", "label").join(flags(samples, package).drop("found"), "snippet_id")


def evaluate(samples: DataFrame, package: tuple[dict, dict] | None = None) -> DataFrame:
    """Metrics of the rules alone, and next to them those of rules and model.

    ``samples``: ``snippet_id, code, label``; with ``predicted, latency_ms`` the rules have judged them already.
    """
    judged = samples.select("snippet_id", "label", "predicted", "latency_ms") if "predicted" in samples.columns else predict(samples)
    rows = judged.withColumn("mode", F.lit("rules"))
    modes = ["rules"]
    if package is not None:
        rows = rows.unionByName(predict(samples, package).withColumn("mode", F.lit("model")))
        modes.append("model")
    return metrics.eval_compare(rows, modes)
