"""Per-language risk models and the issue and severity classifiers."""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructType

from reviewlake.functions import fixed
from reviewlake.operators import boosting, scoring, trees
from reviewlake.operators.metrics import (
    binary_metrics, class_report, report_summary, threshold_sweep,
)
from reviewlake.operators.sampling import class_guard, hashed_rank, stratified_split
from reviewlake.sources.stage import staged

ALL = "all"
"""What stands for the language of a model of all languages."""


@dataclass
class TrainSettings:
    """Size of the search; the defaults are the full procedure on all labelled rows.

    ``fit_rows``, if given, bounds the labelled rows of a language that trees are grown on: an even sample in hash order within
    each class. Thresholds and metrics always use all rows.
    """

    candidates: int = 25
    grid: dict = field(default_factory=lambda: dict(fixed.FOREST_GRID))
    folds: int = 5
    seed: int = 42
    fit_rows: int | None = None


@dataclass
class CalibratedForest:
    """A forest and a logistic curve for each fold; a probability is the mean over the folds.

    ``nodes`` is the table of ``trees.fit_forests`` for one language, ``curves`` the (slope, intercept) of each fold.
    """

    nodes: DataFrame
    curves: list[tuple[float, float]]

    def save(self, folder: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        rows = self.nodes.sparkSession.createDataFrame(
            [(i, a, b) for i, (a, b) in enumerate(self.curves)], "fit int, slope double, intercept double")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/curves")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CalibratedForest:
        curves = spark.read.parquet(f"{folder}/curves").orderBy("fit").collect()
        return cls(spark.read.parquet(f"{folder}/nodes"), [(r["slope"], r["intercept"]) for r in curves])


def _features_looked_at(name: str) -> int:
    n = len(fixed.FEATURES)
    return {"sqrt": math.isqrt(n), "log2": int(math.log2(n)), "all": n}[name]


def candidates(settings: TrainSettings) -> list[dict]:
    """Random parameter sets, without repeats."""
    rng, grid = random.Random(settings.seed), settings.grid
    n_all = math.prod(len(v) for v in grid.values())
    picked: set = set()
    while len(picked) < min(settings.candidates, n_all):
        picked.add(tuple(rng.randrange(len(v)) for v in grid.values()))
    return [{name: values[i] for (name, values), i in zip(grid.items(), combo, strict=True)} for combo in sorted(picked)]


def _deepest(params: dict) -> int:
    return trees.DEEPEST if params["max_depth"] is None else params["max_depth"]


def shared_fits(language: str, folds: int, sets: list[dict]) -> tuple[list[trees.Fit], list[list[tuple]]]:
    """The forests that must be grown for all candidates, and which candidates each of them serves.

    Candidates with the same smallest leaf and features share trees: as many as the largest asks for, as deep as the deepest.
    """
    families: dict[tuple, list] = {}
    for number, p in enumerate(sets):
        families.setdefault((p["min_leaf"], _features_looked_at(p["features"])), []).append(
            (number, p["num_trees"], p["min_split"], _deepest(p)))
    fits, asked = [], []
    for (least_leaf, n_features), members in sorted(families.items()):
        for fold in range(folds):
            fits.append(trees.Fit(language, fold, max(m[1] for m in members), n_features, least_leaf,
                                  min(m[2] for m in members), max(m[3] for m in members)))
            asked.append(members)
    return fits, asked


def fit_sample(train: DataFrame, folds: dict[str, dict[str, int]], settings: TrainSettings) -> DataFrame:
    """All rows (at most ``fit_rows`` of each language, if that is given), with a column for each kind of fold
    (name -> language -> folds)."""
    keys, sample = ["review_language", "label"], train
    if settings.fit_rows is not None:
        ranked = hashed_rank(train, keys, "snippet_id", settings.seed)
        sizes = {r["review_language"]: r["count"] for r in train.groupBy("review_language").count().collect()}
        share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, settings.fit_rows / n)))])
        most = F.greatest(F.lit(2), F.floor(F.col("group_size") * F.try_element_at(share, F.col("review_language"))))
        sample = ranked.filter(F.col("hash_rank") <= most).drop("hash_rank", "group_size")
    for step, (name, per_language) in enumerate(folds.items(), 1):
        number = F.try_element_at(F.create_map(*[x for k, n in per_language.items() for x in (F.lit(k), F.lit(n))]),
                                  F.col("review_language"))
        sample = hashed_rank(sample, keys, "snippet_id", settings.seed + 7 * step).withColumn(
            name, (F.col("hash_rank") % number).cast("int")).drop("hash_rank", "group_size")
    return sample


def _sum_if(met: Column) -> Column:
    return F.sum(F.when(met, F.col("n")).otherwise(0))


def fold_f_betas(votes: DataFrame) -> DataFrame:
    """``language, candidate, fold, f_beta`` of class 1, where more than half of the votes are for it; a row stands for ``n``.

    Votes are rounded, since their sum depends in its last digits on the order of the parts.
    """
    said = F.round("votes", 9) > 0.5
    counts = votes.groupBy("language", "candidate", "fold").agg(
        _sum_if(said & (F.col("label") == 1)).alias("tp"), _sum_if(said & (F.col("label") == 0)).alias("fp"),
        _sum_if(~said & (F.col("label") == 1)).alias("fn"))
    betas = {**{k: 1.0 for k in fixed.SUPPORTED}, **fixed.SEARCH_BETA}
    beta = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in betas.items() for x in (F.lit(k), F.lit(float(v)))]),
                                       F.col("language")), F.lit(1.0))
    hits = (1 + beta * beta) * F.col("tp")
    below = hits + beta * beta * F.col("fn") + F.col("fp")
    return counts.select("language", "candidate", "fold", F.when(below > 0, hits / below).otherwise(0.0).alias("f_beta"))


def tune_forests(spark: SparkSession, blocks: dict[str, trees.Rows], folds: dict[str, int], settings: TrainSettings
                 ) -> dict[str, tuple[dict, float]]:
    """For each language the best parameters by stratified cross-validation on F-beta, and their score.

    All candidates, folds and languages are grown and scored in one job; ties go to the first candidate.
    """
    sets = candidates(settings)
    fits, asked = [], []
    for language in sorted(folds):
        more, serves = shared_fits(language, folds[language], sets)
        fits, asked = fits + more, asked + serves
    scored = fold_f_betas(trees.fold_scores(spark, blocks, fits, asked, settings.seed))
    means = scored.groupBy("language", "candidate").agg(F.array_sort(F.collect_list("f_beta")).alias("scores")).collect()
    best: dict[str, tuple[dict, float]] = {}
    for r in sorted(means, key=lambda r: (r["language"], r["candidate"])):
        score = math.fsum(r["scores"]) / len(r["scores"])
        if r["language"] not in best or score > best[r["language"]][1]:
            best[r["language"]] = (sets[r["candidate"]], score)
    return best


def sigmoid_curve(score: np.ndarray, label: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve with the least loss against smoothed targets, by Newton steps."""
    hits, misses = float(count[label == 1].sum()), float(count[label == 0].sum())
    target = np.where(label == 1, (hits + 1) / (hits + 2), 1 / (misses + 2))
    x = np.stack([score, np.ones(len(score))], axis=1)

    def loss(at):
        z = x @ at
        return float((count * (np.logaddexp(0, z) - target * z)).sum())

    at = np.array([0.0, math.log((hits + 1) / (misses + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (count * (p - target))
        bend = (x * (count * p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(2)
        step, size, now = np.linalg.solve(bend, slope), 1.0, loss(at)
        while size > 1e-10 and loss(at - size * step) > now:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(at[0]), float(at[1])


def sigmoid_curves(held_out: DataFrame) -> dict[str, list[tuple[float, float]]]:
    """A curve for each language and fold from ``review_language, fit, score, label``; equal scores are counted first, a task a curve."""
    def curve(key, own):
        own = own.sort_values(["score", "label"])
        slope, intercept = sigmoid_curve(own["score"].to_numpy(float), own["label"].to_numpy(int), own["count"].to_numpy(float))
        return pd.DataFrame({"review_language": [key[0]], "fit": [key[1]], "slope": [slope], "intercept": [intercept]})

    counted = held_out.groupBy("review_language", "fit", "score", "label").count()
    found = counted.groupBy("review_language", "fit").applyInPandas(
        curve, "review_language string, fit int, slope double, intercept double").collect()
    out: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["review_language"], r["fit"])):
        out.setdefault(r["review_language"], []).append((r["slope"], r["intercept"]))
    return out


def own_fold_scores(sample: DataFrame, nodes: DataFrame, fold: str, classes: int) -> DataFrame:
    """``review_language, snippet_id, label, fit, scores``: each row judged by the forest that has not seen it."""
    scored = trees.forest_scores(sample.select("review_language", "snippet_id", "label", F.col(fold).alias("fit"), *fixed.FEATURES),
                                 nodes, fixed.FEATURES, "review_language", "all_scores")
    own = F.slice("all_scores", F.col("fit") * classes + 1, F.lit(classes))
    return scored.select("review_language", "snippet_id", F.col("label").cast("int").alias("label"), "fit", own.alias("scores"))


def calibrated_forests(sample: DataFrame, blocks: dict[str, trees.Rows], cuts: dict, params: dict[str, dict], folds: dict[str, int],
                       seed: int = 42) -> dict[str, CalibratedForest]:
    """For each language a forest per fold, and a curve on the scores of the rows that it has not seen.

    ``sample`` has the fold in ``part``, and so do the rows of ``blocks``.
    """
    spark = sample.sparkSession
    fits = [trees.Fit(language, fold, p["num_trees"], _features_looked_at(p["features"]), p["min_leaf"], p["min_split"], _deepest(p))
            for language, p in sorted(params.items()) for fold in range(folds[language])]
    nodes = staged(trees.fit_forests(spark, blocks, cuts, fits, 2, seed), "nodes")
    own = own_fold_scores(sample, nodes, "part", 2)
    curves = sigmoid_curves(own.select("review_language", "fit", F.round(F.get("scores", 1), 12).alias("score"), "label"))
    return {language: CalibratedForest(nodes.filter(F.col("language") == language), curves[language]) for language in params}


def predict_probability(models: dict[str, CalibratedForest], rows: DataFrame, model: str = "review_language") -> DataFrame:
    """Add ``probability`` by the language's model in column ``model``; null where there is none."""
    nodes = None
    for language, forest in models.items():
        own = forest.nodes.withColumn("language", F.lit(language))
        nodes = own if nodes is None else nodes.unionByName(own)
    scored = trees.forest_scores(rows, nodes, fixed.FEATURES, model, "_scores")
    curves = F.create_map(*[x for language, forest in models.items() for x in (F.lit(language), F.array(
        *[F.struct(F.lit(a).alias("slope"), F.lit(b).alias("intercept")) for a, b in forest.curves]))])
    of_fit = F.transform(F.try_element_at(curves, F.col(model)), lambda c, i: 1 / (1 + F.exp(
        -(c["slope"] * F.round(F.get("_scores", 2 * i + 1), 12) + c["intercept"]))))
    mean = F.aggregate(of_fit, F.lit(0.0), lambda a, p: a + p) / F.size(of_fit)
    return scored.withColumn("probability", mean).drop("_scores")


def train_models(rows: DataFrame, settings: TrainSettings | None = None
                 ) -> tuple[dict[str, CalibratedForest], dict]:
    """One model per language of ``snippet_id, review_language, <features>, bug_risk``.

    Split, search, calibrate, choose the threshold, and measure on the held-out part: each step is one pass for all languages.
    """
    settings = settings or TrainSettings()
    spark = rows.sparkSession
    guard = class_guard(rows, fixed.SUPPORTED).orderBy("review_language").collect()
    if not guard:
        raise ValueError("Empty dataset.")
    skipped = {r["review_language"]: r["reason"] for r in guard if r["reason"]}
    languages = [r["review_language"] for r in guard if not r["reason"]]
    if not languages:
        raise ValueError("No language models were trained. Check dataset size/class balance.")
    usable = rows.filter(F.col("review_language").isin(languages)).withColumn("label", F.col("bug_risk").cast("int"))
    split = staged(stratified_split(usable, ["review_language", "label"], "snippet_id", seed=settings.seed), "split")
    train = split.filter("not is_test")
    sizes = {(r["review_language"], r["is_test"], r["label"]): r["count"]
             for r in split.groupBy("review_language", "is_test", "label").count().collect()}
    least = {k: min(n for (own, test, _), n in sizes.items() if own == k and not test) for k in languages}
    tuner = {k: min(settings.folds, n) for k, n in least.items()}
    parts = {k: min(3, n) for k, n in least.items()}
    sample = staged(fit_sample(train, {"fold": tuner, "part": parts}, settings), "fit-sample")
    blocks, cuts = trees.collected(sample, fixed.FEATURES)
    best = tune_forests(spark, blocks, tuner, settings)
    by_part, _ = trees.collected(sample, fixed.FEATURES, "part")
    models = calibrated_forests(sample, by_part, cuts, {k: p for k, (p, _) in best.items()}, parts, settings.seed)
    scored = staged(predict_probability(models, split.select("snippet_id", "review_language", "label", "is_test", *fixed.FEATURES))
                    .select("snippet_id", "review_language", "label", "is_test", "probability"), "scored")
    choice = {r["review_language"]: r.asDict() for r in threshold_sweep(
        scored.filter("not is_test"), fixed.THRESHOLD_BETA, fixed.MIN_RECALL).collect()}
    thresholds = {k: c["threshold"] for k, c in choice.items()}
    cut = F.element_at(F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))]), F.col("review_language"))
    test = scored.filter("is_test").withColumn("threshold", cut)
    measured = {r["review_language"]: r.asDict() for r in binary_metrics(test, ["review_language"]).collect()}
    report = class_report(test.withColumn("predicted", (F.col("probability") >= F.col("threshold")).cast("int")),
                          "label", "predicted", ("review_language",))
    report = report.withColumn("class", F.col("class").cast("string")).unionByName(
        report_summary(report, ("review_language",))).collect()
    metas = {k: {
        "language": k, "n_features": len(fixed.FEATURES),
        "train_size": sum(n for (own, is_test, _), n in sizes.items() if own == k and not is_test),
        "test_size": sum(n for (own, is_test, _), n in sizes.items() if own == k and is_test),
        "fit_size": len(blocks[k].key), "cv_splits_tuner": tuner[k], "cv_splits_calibrator": parts[k],
        "best_params": best[k][0], "search_beta": fixed.SEARCH_BETA.get(k, 1.0),
        "best_cv_score": best[k][1], "decision_threshold": thresholds[k],
        "threshold_selection_train": choice[k], "metrics": measured.get(k, {}),
        "classification_report": sorted((r.asDict() for r in report if r["review_language"] == k), key=lambda r: r["class"]),
    } for k in languages}
    default = "python" if "python" in models else next(iter(models))
    meta = {
        "artifact_version": "3.0", "feature_names": fixed.FEATURES, "default_language": default,
        "random_state": settings.seed, "total_samples": sum(r["n_samples"] for r in guard),
        "trained_languages": sorted(models), "skipped_languages": skipped,
        "language_metrics": metas, "decision_thresholds": thresholds,
    }
    return models, meta


def batch_probabilities(rows: DataFrame, models: dict[str, CalibratedForest],
                        meta: dict) -> DataFrame:
    """``snippet_id, probability, threshold`` by the language's model, else the default one.

    ``rows`` needs ``n_issues`` and the features; rows whose risk the rules settle
    do not meet a model.
    """
    use = rows.filter(scoring.needs_model(F.col("n_issues"), F.col("num_loops"),
                                          F.col("num_ifs")))
    thresholds = meta.get("decision_thresholds", {})
    fallback = "python" if "python" in models else meta["default_language"]
    own = [k for k in fixed.SUPPORTED if k in models]
    language = F.col("review_language")
    named = use.select("snippet_id", F.when(language.isin(own), language).otherwise(F.lit(fallback)).alias("model"),
                       language.isin(own).alias("has_own"), *fixed.FEATURES)
    scored = predict_probability(models, named, "model")
    other = float(thresholds.get("python", 0.5))
    cut = F.when(F.col("has_own"), F.element_at(F.create_map(
        *[x for k in models for x in (F.lit(k), F.lit(float(thresholds.get(k, other))))]), F.col("model"))).otherwise(F.lit(other))
    return scored.select("snippet_id", "probability", cut.alias("threshold"))


# ---- issue and severity classifiers ----------------------------------------

def issue_dataset(features: DataFrame, results: DataFrame) -> DataFrame:
    """Features with the first ranked issue; classes of one row are dropped."""
    rows = features.join(results.select("snippet_id", "issues"), "snippet_id").withColumn(
        "issue", scoring.primary_issue(F.col("issues"))).drop("issues")
    kept = rows.groupBy("issue").count().filter("count >= 2").select("issue")
    return rows.join(kept, "issue", "left_semi")


def severity_dataset(features: DataFrame, results: DataFrame) -> DataFrame:
    """Features with the worst severity of the issues."""
    worst = scoring.worst_severity(F.col("issues.name"), F.col("confidence"))
    return features.join(results.select("snippet_id", worst.alias("severity")), "snippet_id")


def encode_labels(rows: DataFrame, column: str):
    """Add ``label``: classes numbered by name. The rows are stored, since they are read for the names and for the numbers."""
    rows = staged(rows, "unencoded")
    model = StringIndexer(inputCol=column, outputCol="label",
                          stringOrderType="alphabetAsc").fit(rows)
    return model.transform(rows), model.labels


def _one_model(rows: DataFrame) -> DataFrame:
    """All languages under one name: these classifiers are not trained by language."""
    return rows.withColumn("review_language", F.lit(ALL))


def balanced_weights(labels: np.ndarray, classes: int, many: np.ndarray) -> np.ndarray:
    counts = np.bincount(labels, many, classes).astype(np.int64)
    return np.where(counts > 0, counts.sum() / np.maximum(1, classes * counts), 0.0)


def _label_column(labels: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), number.cast("int") + 1)


@dataclass
class IssueModel:
    """Boosted trees: in the table of nodes a class is a fit and a round a tree, whose one vote adds to the class's margin."""

    nodes: DataFrame
    labels: list[str]
    rounds: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``probabilities`` (by class) and ``predicted``; ties go to the first class."""
        scored = trees.forest_scores(rows.withColumn("_model", F.lit(ALL)), self.nodes, fixed.FEATURES, "_model", "_margins")
        margins = F.transform("_margins", lambda m: m * self.rounds)
        grown = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
        total = F.aggregate(grown, F.lit(0.0), lambda a, x: a + x)
        best = F.array_position("probabilities", F.array_max("probabilities")) - 1
        return (scored.withColumn("probabilities", F.transform(grown, lambda x: F.round(x / total, 12)))
                .withColumn("predicted", _label_column(self.labels, best)).drop("_margins", "_model"))

    def save(self, folder: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        write_meta(self.nodes.sparkSession, {"labels": self.labels, "rounds": self.rounds}, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> IssueModel:
        meta = read_meta(spark, folder)
        return cls(spark.read.parquet(f"{folder}/nodes"), meta["labels"], meta["rounds"])


def train_issue_classifier(dataset: DataFrame, rounds: int = 300, depth: int = 6, rate: float = 0.1, subsample: float = 0.8,
                           features_a_tree: float = 0.8, fit_rows: int | None = None, seed: int = 42) -> tuple[IssueModel, DataFrame]:
    """Boosted trees on softmax gradients, a tree a class in each round; returns the model and a class report.

    All rows of the training part are grown on; with ``fit_rows`` at most so many, an even sample of each class.
    """
    spark = dataset.sparkSession
    encoded, labels = encode_labels(dataset, "issue")
    split = staged(_one_model(stratified_split(encoded.withColumn("label", F.col("label").cast("int")), ["label"], "snippet_id",
                                               seed=seed)), "issue-split")
    sample = staged(fit_sample(split.filter("not is_test"), {"fold": {ALL: 1}}, TrainSettings(seed=seed, fit_rows=fit_rows)),
                    "issue-sample")
    blocks, cuts = trees.collected(sample, fixed.FEATURES)
    nodes = boosting.boosted(spark, blocks[ALL], cuts[ALL], len(labels), rounds, depth, rate, subsample, features_a_tree, seed)
    model = IssueModel(staged(nodes.withColumn("language", F.lit(ALL)), "issue-nodes"), labels, rounds)
    return model, class_report(model.predict(split.filter("is_test")), "issue", "predicted")


# ---- isotonic curves ---------------------------------------------------------------

BLOCK = "low double, high double, weight double, total double"


def pooled(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    """Adjacent blocks (in order) that decrease are pooled until none does."""
    out: list[list[float]] = []
    for row in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist(), strict=True):
        out.append(list(row))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, top, more, added = out.pop()
            out[-1][1] = top
            out[-1][2] += more
            out[-1][3] += added
    return pd.DataFrame(out, columns=["low", "high", "weight", "total"])


def isotonic_curves(points: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, low, high, value``: the increasing steps nearest to the hits, by weighted squares.

    ``points``: ``score`` from 0 to 1, ``hit`` (0 or 1), ``weight``. Equal scores are added up first. Pooling inside ranges of
    scores and then pooling what is left gives the same steps as pooling all at once, so ranges are pooled in tasks of their own.
    """
    summed = points.groupBy(*groups, "score").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("hit")).alias("total"))
    kinds = ", ".join(f"`{g}` {points.schema[g].dataType.simpleString()}" for g in groups)

    def pool(key, frame):
        frame = frame.sort_values("low")
        steps = pooled(*[frame[c].to_numpy(float) for c in ("low", "high", "weight", "total")])
        for g, value in reversed(list(zip(groups, key, strict=False))):
            steps.insert(0, g, value)
        return steps

    parts = (summed.filter("weight > 0").select(*groups, F.col("score").alias("low"), F.col("score").alias("high"), "weight", "total",
                                                F.floor(F.col("score") * 64).alias("_range"))
             .groupBy(*groups, "_range").applyInPandas(pool, f"{kinds}, {BLOCK}"))
    return (parts.groupBy(*groups).applyInPandas(pool, f"{kinds}, {BLOCK}")
            .select(*groups, "low", "high", (F.col("total") / F.col("weight")).alias("value")))


@dataclass
class SeverityModel:
    """For each fold a forest and an isotonic curve per class; class probabilities are means over the folds."""

    nodes: DataFrame
    curves: DataFrame
    labels: list[str]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``probabilities`` (they sum to 1) and the most likely severity, ``predicted``; ties go to the first class."""
        scored = trees.forest_scores(rows.withColumn("_model", F.lit(ALL)), self.nodes, fixed.FEATURES, "_model", "_scores").drop("_model")
        scored = calibrated(scored, self.curves, len(self.labels))
        best = F.array_position("probabilities", F.array_max("probabilities")) - 1
        return scored.withColumn("predicted", _label_column(self.labels, best))

    def save(self, folder: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        self.curves.write.mode("overwrite").parquet(f"{folder}/curves")
        write_meta(self.nodes.sparkSession, {"labels": self.labels}, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SeverityModel:
        return cls(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/curves"), read_meta(spark, folder)["labels"])


def calibrated(scored: DataFrame, curves: DataFrame, classes: int) -> DataFrame:
    """Replace ``_scores`` (fit by fit) by ``probabilities``: scores through their curves, made to sum to 1, averaged over the fits.

    Curves run straight between their steps and are level beyond the first and the last. What is left of pooling, far fewer points
    than rows, is broadcast.
    """
    points: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    frame = curves.toPandas().sort_values(["fit", "class", "low"])
    for key, own in frame.groupby(["fit", "class"]):
        points[key] = (own[["low", "high"]].to_numpy(float).ravel(), np.repeat(own["value"].to_numpy(float), 2))
    shared = scored.sparkSession.sparkContext.broadcast(points)
    kept = [c for c in scored.columns if c != "_scores"]
    schema = StructType([scored.schema[c] for c in kept]).add("probabilities", ArrayType(DoubleType()))
    fields = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.array(batch.column("_scores").to_pylist(), float).reshape(batch.num_rows, -1, classes)
            mapped = np.zeros_like(scores)
            for (fit, c), (x, y) in shared.value.items():
                mapped[:, fit, c] = np.interp(scores[:, fit, c], x, y)
            total = mapped.sum(axis=2, keepdims=True)
            even = np.full_like(mapped, 1.0 / classes)
            found = np.where(total > 0, mapped / np.where(total > 0, total, 1.0), even).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(list(found), pa.list_(pa.float64()))],
                                             schema=fields)

    return scored.mapInArrow(run, schema)


def train_severity_classifier(dataset: DataFrame, n_trees: int = 300, depth: int = 10, least_split: int = 5, folds: int = 3,
                              fit_rows: int | None = None, seed: int = 42) -> tuple[SeverityModel, DataFrame]:
    """A forest for each fold, and isotonic curves per class on the scores of the fold it has not seen; model and class report."""
    spark = dataset.sparkSession
    encoded, labels = encode_labels(dataset, "severity")
    split = staged(_one_model(stratified_split(encoded.withColumn("label", F.col("label").cast("int")), ["label"], "snippet_id",
                                               seed=seed)), "severity-split")
    settings = TrainSettings(seed=seed, fit_rows=fit_rows)
    sample = staged(fit_sample(split.filter("not is_test"), {"fold": {ALL: folds}}, settings), "severity-sample")
    blocks, cuts = trees.collected(sample, fixed.FEATURES)
    weight = balanced_weights(blocks[ALL].label, len(labels), blocks[ALL].sizes())
    fits = [trees.Fit(ALL, fold, n_trees, _features_looked_at("sqrt"), 1, least_split, depth, tuple(weight)) for fold in range(folds)]
    nodes = staged(trees.fit_forests(spark, blocks, cuts, fits, len(labels), seed), "severity-nodes")
    own = own_fold_scores(sample, nodes, "fold", len(labels))
    points = own.select("fit", F.posexplode("scores").alias("class", "score"), "label",
                        F.get(F.array(*map(F.lit, weight.tolist())), F.col("label")).alias("weight")).select(
        "fit", "class", F.round("score", 12).alias("score"), (F.col("label") == F.col("class")).cast("double").alias("hit"), "weight")
    model = SeverityModel(nodes, staged(isotonic_curves(points, ["fit", "class"]), "severity-curves"), labels)
    return model, class_report(model.predict(split.filter("is_test")), "severity", "predicted")


def write_meta(spark: SparkSession, meta: dict, folder: str) -> None:
    rows = spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def read_meta(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/meta").first()["value"])
