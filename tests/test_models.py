import inspect
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.operators import boosting, metrics, models, sampling, trees
from reviewlake.plans.catalog import SMALL
from reviewlake.sources import sinks


def _scored(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "snippet_id long, review_language string, label int, probability double")


def _best(labels, probs, beta, floor):
    """Best cut by trying each one."""
    labels, probs = np.array(labels), np.array(probs)
    table = []
    for cut in metrics.CUTS:
        pred = probs >= cut
        if not pred.any():
            continue
        tp = int((pred & (labels == 1)).sum())
        p, r = tp / int(pred.sum()), tp / max(1, int(labels.sum()))
        f1 = 2.0 * tp / (int(pred.sum()) + int(labels.sum()))
        fb = (1 + beta * beta) * p * r / max(beta * beta * p + r, 1e-12)
        table.append((cut, f1, fb, p, r))
    good = [t for t in table if floor is not None and t[4] >= floor]
    if good:
        return max(good, key=lambda t: (t[1], t[3], -t[0]))[0]
    return max(table, key=lambda t: (t[2], t[4], -t[0]))[0] if table else 0.5


def test_threshold_sweep(spark):
    rng = random.Random(1)
    edge = [0.05, 0.95, 0.5, 0.0, 1.0, *metrics.CUTS[::20], *[c - 1e-16 for c in metrics.CUTS[::20]]]
    rows = []
    for lang in ("python", "cpp", "java"):
        for _ in range(400):
            label = int(rng.random() < 0.4)
            p = rng.choice(edge) if rng.random() < 0.3 else min(1.0, max(0.0, rng.gauss(
                0.35 + 0.3 * label, 0.2)))
            rows.append((lang, label, p))
    rows += [("low", 1, 0.01), ("low", 0, 0.02)]
    got = {r.review_language: r for r in metrics.threshold_sweep(
        _scored(spark, rows), fixed.THRESHOLD_BETA, fixed.MIN_RECALL).collect()}
    for lang in ("python", "cpp", "java"):
        mine = [r for r in rows if r[0] == lang]
        assert got[lang].threshold == _best([r[1] for r in mine], [r[2] for r in mine],
                                            fixed.THRESHOLD_BETA[lang], fixed.MIN_RECALL.get(lang))
    assert (got["low"].threshold, got["low"].f1) == (0.5, 0.0)


def test_rank_auc(spark):
    rng = random.Random(2)
    rows = [("a", int(rng.random() < 0.3), rng.choice([0.1, 0.2, rng.random(), 1.0, 0.0]))
            for _ in range(600)] + [("one", 1, 0.5), ("one", 1, 0.7)]
    got = {r.review_language: r.roc_auc
           for r in metrics.rank_auc(_scored(spark, rows), ["review_language"]).collect()}
    pos = [r[2] for r in rows if r[0] == "a" and r[1]]
    neg = [r[2] for r in rows if r[0] == "a" and not r[1]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got["a"] - want) < 1e-12 and got["one"] == 0.5


def test_hash_rank_is_a_whole_order(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    rows = sampling.hashed_rank(frame, ["label"], "id").collect()
    for label in (0, 1):
        ranks = sorted(r.hash_rank for r in rows if r.label == label)
        assert ranks == list(range(1, len(ranks) + 1))
        assert all(r.group_size == len(ranks) for r in rows if r.label == label)
    split = sampling.stratified_split(frame, ["label"], "id")
    test = {r.label: r["count"] for r in split.filter("is_test").groupBy("label").count().collect()}
    assert test == {0: int(4285 * 0.2 + 0.5), 1: int(715 * 0.2 + 0.5)}
    folds = sampling.stratified_folds(frame, ["label"], "id", 3).groupBy("label", "fold").count()
    for label, n in ((0, 4285), (1, 715)):
        sizes = [r["count"] for r in folds.filter(F.col("label") == label).collect()]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_class_guard_and_weights(spark):
    rows = ([("python", 0)] * 8 + [("python", 1)] * 4 + [("cpp", 1)] * 5 + [("java", 0)] * 9
            + [("java", 1)] + [("go", 1)])
    frame = spark.createDataFrame(rows, "review_language string, bug_risk int")
    got = {r.review_language: r.reason
           for r in sampling.class_guard(frame, fixed.SUPPORTED).collect()}
    assert got == {"python": None, "cpp": "cpp: requires at least 2 classes.",
                   "java": "java: not enough samples per class after split.",
                   "go": "unsupported_language"}
    weights = sampling.class_weights(frame, "bug_risk", ("review_language",)).filter(
        "review_language = 'python'").select("bug_risk", "weight").distinct().collect()
    assert {r.bug_risk: r.weight for r in weights} == {0: 12 / 16, 1: 12 / 8}


def test_eval_metrics(spark):
    rows = [(1, 1, 10.0), (1, 0, 20.0), (0, 1, 30.0), (0, 0, 40.0), (0, 0, 50.0)]
    frame = spark.createDataFrame(rows, "label int, predicted int, latency_ms double").withColumn(
        "g", F.lit(0))
    r = metrics.eval_metrics(frame, ["g"]).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    assert abs(r.false_positive_rate - 1 / 3) < 1e-12
    assert abs(r.p95_latency_ms - np.percentile([10, 20, 30, 40, 50], 95)) < 1e-9


def test_percentiles_are_exact(spark):
    """Bit for bit what the buffering aggregate gives, without its buffer."""
    rng = random.Random(12)
    special = [0.0, -0.0, 1e-308, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 2.0, 0.9999999999999999,
               1.9999999999999998, 2.0000000000000004, 4.0, 8.0, 1024.0, -1024.0, 0.1, 0.2, 0.30000000000000004]
    rows = [("mixed", rng.choice(special)) for _ in range(300)] + [("one", 7.5), ("none", None), (None, 3.0), (None, 4.0)]
    rows += [("smooth", rng.expovariate(1) * 10 ** rng.randrange(-5, 6)) for _ in range(2000)]
    rows += [("near", 1 + rng.randrange(40) * 2.0 ** -52) for _ in range(500)] + [("nan", float("nan")), ("nan", 1.0)]
    frame = spark.createDataFrame(rows, "g string, v double").cache()
    for share in (0.0, 0.25, 0.5, 0.95, 0.999, 1.0):
        found = metrics.exact_percentile(frame, ["g"], "v", share, "p")
        want = {r.g: r.p for r in frame.groupBy("g").agg(F.percentile("v", share).alias("p")).collect()}
        got = {r.g: r.p for r in found.collect()}
        assert want.pop("none") is None
        assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def train_rows(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        lang, label = ("python", "cpp")[i % 2], i % 3 == 0
        x = [rng.randrange(4) + (3 if label and j in (2, 11) else 0) for j in range(12)]
        rows.append((i, lang, *x, int(label)))
    rows += [(1000, "java", *[1] * 12, 1), (1001, "go", *[1] * 12, 0)]
    columns = ", ".join(f"{f} int" for f in fixed.FEATURES)
    return spark.createDataFrame(rows, f"snippet_id long, review_language string, {columns}, "
                                       "bug_risk int").cache()


def test_training_saving_and_scoring(spark, train_rows, tmp_path):
    package, meta = models.train_models(train_rows, SMALL)
    assert meta["trained_languages"] == ["cpp", "python"] and meta["default_language"] == "python"
    assert set(meta["skipped_languages"]) == {"java", "go"}
    assert all(m["metrics"]["roc_auc"] > 0.8 for m in meta["language_metrics"].values())
    folder = str(tmp_path / "package")
    sinks.save_package(spark, package, meta, folder)
    loaded, loaded_meta = sinks.load_package(spark, folder)
    assert loaded_meta == meta
    rows = train_rows.withColumn("n_issues", F.lit(1))
    a = {r.snippet_id: (r.probability, r.threshold)
         for r in models.batch_probabilities(rows, package, meta).collect()}
    b = {r.snippet_id: (r.probability, r.threshold)
         for r in models.batch_probabilities(rows, loaded, loaded_meta).collect()}
    assert a == b and len(a) == 242
    assert all(0 <= p <= 1 for p, _ in a.values())
    # languages without a model use the python one
    assert a[1000][1] == meta["decision_thresholds"]["python"]
    # settled rows meet no model
    settled = train_rows.withColumn("n_issues", F.lit(2))
    assert models.batch_probabilities(settled, package, meta).count() == 0
    bare = str(tmp_path / "bare")
    package["python"].save(bare)
    legacy, legacy_meta = sinks.load_package(spark, bare)
    assert legacy_meta["artifact_version"] == "legacy"
    a = models.predict_probability(package, train_rows.filter("review_language = 'python'")).select("snippet_id", "probability")
    b = models.predict_probability(legacy, train_rows.filter("review_language = 'python'")).select("snippet_id", "probability")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    # no model, no probability; null features count as 0
    odd = train_rows.filter("snippet_id in (0, 1001)").withColumn("num_ifs", F.lit(None).cast("int"))
    got = {r.snippet_id: r.probability for r in models.predict_probability(package, odd).collect()}
    assert got[1001] is None and 0 <= got[0] <= 1


def test_fit_rows_bound_the_sample_only(spark, train_rows):
    settings = models.TrainSettings(candidates=2, folds=2, grid=SMALL.grid, fit_rows=60)
    _, meta = models.train_models(train_rows, settings)
    python = meta["language_metrics"]["python"]
    assert 50 <= python["fit_size"] <= 60 and python["train_size"] == 96 and python["test_size"] == 24


# ---- forests ------------------------------------------------------------------------

def _rows(n=200, seed=1, classes=2):
    rng = np.random.default_rng(seed)
    values = rng.poisson(2, (n, 12)).astype(float)
    label = np.clip(((values[:, 2] + values[:, 11] + rng.normal(0, 1, n)) / 3).astype(int), 0, classes - 1)
    cuts = [trees.bin_edges(values[:, f]) for f in range(12)]
    bins = np.stack([np.searchsorted(c, values[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
    rows = trees.Rows(bins, label, np.arange(n) % 5, rng.integers(0, 2**63, n).astype(np.uint64), np.arange(n))
    return rows, values, cuts


def _plain_tree(rows, use, number, classes, n_features, least_leaf, least_split, deepest, seed):
    """One tree by recursion, trying every cut of a node: {row: votes}."""
    drawn = trees.draws(rows.key[use], np.array([number]), seed)[0]
    bag = [(int(i), int(c)) for i, c in zip(use, drawn) if c]
    whole = [sum(c for i, c in bag if rows.label[i] == k) for k in range(classes)]
    weight = [sum(whole) / (sum(n > 0 for n in whole) * n) if n else 0.0 for n in whole]
    leaves = {}

    def counts(own):
        return np.array([sum(c for i, c in own if rows.label[i] == k) for k in range(classes)], float)

    def grow(own, test, path, depth):
        total = counts(own)
        votes = total * weight / (total * weight).sum()
        best = (-1.0, None, None)
        if depth < deepest and total.sum() >= max(least_split, 2 * least_leaf) and (total > 0).sum() > 1:
            order = trees.mixed(path + np.arange(1, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            varies = [len({rows.bins[i, f] for i, _ in own}) > 1 for f in range(12)]
            for f in [f for f in np.argsort(order, kind="stable") if varies[f]][:n_features]:
                for cut in range(int(rows.bins.max())):
                    left = counts([(i, c) for i, c in own if rows.bins[i, f] <= cut])
                    right = total - left
                    if min(left.sum(), right.sum()) >= max(1, least_leaf):
                        a, b = left * weight, right * weight
                        gain = (a * a).sum() / a.sum() + (b * b).sum() / b.sum()
                        if gain > best[0]:
                            best = (gain, f, cut)
        if best[1] is None:
            leaves.update({int(i): votes for i in test})
            return
        _, f, cut = best
        with np.errstate(over="ignore"):
            for side, step in ((False, 1), (True, 2)):
                grow([(i, c) for i, c in own if (rows.bins[i, f] > cut) == side],
                     [i for i in test if (rows.bins[i, f] > cut) == side],
                     trees.mixed(path * np.uint64(2) + np.uint64(step)), depth + 1)

    with np.errstate(over="ignore"):
        root = trees.mixed(np.uint64(number) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    grow(bag, range(len(rows.label)), root, 0)
    return leaves


@pytest.mark.parametrize("shape", [(3, 1, 2, trees.DEEPEST), (12, 2, 8, 4), (3, 6, 2, trees.DEEPEST)])
@pytest.mark.parametrize("classes", [2, 3])
def test_trees_equal_a_plain_grower(shape, classes, monkeypatch):
    monkeypatch.setattr(trees, "CELLS", 500)
    n_features, least_leaf, least_split, deepest = shape
    rows, _, _ = _rows(120, 7, classes)
    use = np.flatnonzero(rows.fold != 1)
    forest = trees.grow(rows, use, np.arange(5, 9), classes, n_features, least_leaf, least_split, deepest, seed=3)
    found = forest.votes[trees.reached(forest, rows.bins, 4)]
    for t in range(4):
        plain = _plain_tree(rows, use, 5 + t, classes, n_features, least_leaf, least_split, deepest, 3)
        assert np.allclose(found[t], [plain[i] for i in range(120)])


def test_smaller_settings_are_cut_out_of_larger_forests():
    rows, _, _ = _rows()
    use = np.flatnonzero(rows.fold != 0)
    large = trees.grow(rows, use, np.arange(20), 2, 3, 2)
    for least_split, deepest, n in ((8, 5, 20), (2, 3, 7), (12, trees.DEEPEST, 1)):
        small = trees.grow(rows, use, np.arange(n), 2, 3, 2, least_split, deepest)
        a = large.votes[trees.reached(large, rows.bins, 20, least_split, deepest)[:n]]
        assert np.array_equal(a, small.votes[trees.reached(small, rows.bins, n)])


def test_pieces_and_portions_change_nothing(spark, monkeypatch):
    rows, values, cuts = _rows()
    fit = [trees.Fit("all", fold, 30, 3, 1) for fold in range(2)]
    asked = [[(0, 30, 2, trees.DEEPEST), (1, 12, 6, 4)]] * 2
    frame = spark.createDataFrame([("all", i, *map(float, v)) for i, v in enumerate(values)],
                                  "m string, i int, " + ", ".join(f"{f} double" for f in fixed.FEATURES))
    seen = []
    for entries, portion in ((trees.ENTRIES, trees.PORTION), (1000, 500)):
        monkeypatch.setattr(trees, "ENTRIES", entries)
        monkeypatch.setattr(trees, "PORTION", portion)
        votes = trees.fold_scores(spark, {"all": rows}, fit, asked)
        nodes = trees.fit_forests(spark, {"all": rows}, {"all": cuts}, fit, 2).cache()
        scores = trees.forest_scores(frame, nodes, fixed.FEATURES, "m")
        seen.append(({(r.candidate, r.fold, r.snippet_id): round(r.votes, 9) for r in votes.collect()},
                     {r.i: [round(s, 9) for s in r.scores] for r in scores.collect()}))
    assert seen[0] == seen[1] and len(seen[0][0]) == 2 * 80
    # what the search has seen of a fold is what the fitted forest says about it
    assert all(abs(seen[0][1][i][2 * fold + 1] - v) < 1e-8 for (c, fold, i), v in seen[0][0].items() if c == 0)


def _copied_rows(classes=2):
    """20 different rows, each 30 times under ids of its own."""
    few, values, cuts = _rows(20, 3, classes)
    n = 600
    rows = trees.Rows(np.tile(few.bins, (30, 1)), np.tile(few.label, 30), np.arange(n) // 20 % 5,
                      np.random.default_rng(2).integers(0, 2**63, n).astype(np.uint64), np.arange(n))
    return rows, np.tile(values, (30, 1)), cuts


def test_copies_grow_and_are_asked_as_one(spark, monkeypatch):
    rows, values, cuts = _copied_rows()
    use = np.flatnonzero(rows.fold != 1)
    assert len(trees.alike(rows.bins[use], rows.label[use])[0]) <= 20
    assert trees.pieces([trees.Fit("all", 0, 64, 3, 1)], {"all": rows}) == [(0, 0, 64)]
    one, sets = trees.alike(rows.bins[use], rows.label[use])
    for entries in (trees.ENTRIES, 1000):
        monkeypatch.setattr(trees, "ENTRIES", entries)
        each = trees.draws(rows.key[use], np.arange(5), 3)
        assert np.array_equal(trees.drawn_alike(rows.key[use], np.arange(5), 3, sets),
                              [[int(t[sets == i].sum()) for i in range(len(one))] for t in each])
    forest = trees.grow(rows, use, np.arange(5, 7), 2, 3, 1, 2, seed=3)
    found = forest.votes[trees.reached(forest, rows.bins, 2)]
    for t in range(2):
        plain = _plain_tree(rows, use, 5 + t, 2, 3, 1, 2, trees.DEEPEST, 3)
        assert np.allclose(found[t], [plain[i] for i in range(600)])
    fit, asked = [trees.Fit("all", 1, 10, 3, 1)], [[(0, 10, 2, trees.DEEPEST)]]
    votes = trees.fold_scores(spark, {"all": rows}, fit, asked).collect()
    assert len(votes) <= 20 and sum(r.n for r in votes) == 120
    nodes = trees.fit_forests(spark, {"all": rows}, {"all": cuts}, fit, 2).toPandas()
    seen = []
    monkeypatch.setattr(trees.Votes, "ask", lambda self, v, ask=trees.Votes.ask: seen.append(len(v)) or ask(self, v))
    shared = type("Shared", (), {"value": {"all": trees.Votes(nodes.assign(fit=0), 1)}})
    batch = pa.RecordBatch.from_pydict({"m": ["all"] * 600 + [None], **{
        f: [*values[:, i], None] for i, f in enumerate(fixed.FEATURES)}})
    fields = batch.schema.append(pa.field("s", pa.list_(pa.float64())))
    got = next(trees._asker(shared, fixed.FEATURES, "m", fields)([batch])).column("s").to_pylist()
    assert got[-1] is None and sum(seen) <= 20
    assert np.allclose(got[:-1], shared.value["all"].ask(values))


def test_all_rows_are_collected_as_counted_sets(spark):
    """No row is left out, cuts are those of all rows, and sets draw and grow what their rows one by one would."""
    rng = np.random.default_rng(8)
    values = np.column_stack([np.round(rng.normal(0, 1, 900), 2) if f < 2 else rng.integers(0, 3, 900) for f in range(12)]).astype(float)
    values[300:600] = values[:300]
    label, ids = (values[:, 0] > 0).astype(int), rng.permutation(900)
    label[300:600] = label[:300]
    frame = spark.createDataFrame([("python" if i % 3 else "cpp", int(ids[i]), int(label[i]), int(ids[i]) % 4, *map(float, v))
                                   for i, v in enumerate(values)], "review_language string, snippet_id long, label int, fold int, "
                                  + ", ".join(f"{f} double" for f in fixed.FEATURES))
    blocks, cuts = trees.collected(frame, fixed.FEATURES)
    keys = {r.snippet_id: r.key for r in frame.select("snippet_id", F.xxhash64("snippet_id").alias("key")).collect()}
    for language, own in (("python", np.arange(900) % 3 > 0), ("cpp", np.arange(900) % 3 == 0)):
        assert all(np.array_equal(cuts[language][f], trees.bin_edges(values[own, f])) for f in range(12))
        bins = np.stack([np.searchsorted(c, values[own, f]) for f, c in enumerate(cuts[language])], axis=1).astype(np.uint8)
        plain = trees.Rows(bins, label[own], ids[own] % 4, np.array([keys[int(i)] for i in ids[own]]).view(np.uint64), ids[own])
        sets = blocks[language]
        assert len(sets.key) == own.sum() > len(sets.label) == len(set(map(tuple, np.column_stack([bins, plain.label, plain.fold]).tolist())))
        want = trees.grow(plain, np.flatnonzero(plain.fold != 1), np.arange(3, 6), 2, 3, seed=5)
        for _ in range(2):
            got = trees.grow(sets, np.flatnonzero(sets.fold != 1), np.arange(3, 6), 2, 3, seed=5)
            assert all(np.array_equal(getattr(want, f), getattr(got, f)) for f in want.__dataclass_fields__)
    many = rng.normal(0, 1, 5001).round(2)
    assert np.array_equal(trees.bin_edges(many), trees.counted_edges(*np.unique(many, return_counts=True)))


def test_fits_use_all_rows_by_default(spark):
    """More rows of a language than the 50,000 that trees were once grown on."""
    rows = spark.range(66_000).select(
        F.col("id").alias("snippet_id"), F.lit("python").alias("review_language"), (F.col("id") % 2).cast("int").alias("bug_risk"),
        *[(F.xxhash64("id", F.lit(i)) % 2 + F.col("id") % 2).alias(f) for i, f in enumerate(fixed.FEATURES)])
    meta = models.train_models(rows, SMALL)[1]["language_metrics"]["python"]
    assert meta["fit_size"] == meta["train_size"] == 52_800
    assert models.TrainSettings().fit_rows is None
    for fit in (models.train_issue_classifier, models.train_severity_classifier):
        assert inspect.signature(fit).parameters["fit_rows"].default is None


def test_sigmoid_curve_is_the_best_one():
    rng = np.random.default_rng(5)
    for n, spread in ((40, 0.5), (400, 0.05), (6, 0.0)):
        label = (rng.random(n) < 0.4).astype(int)
        label[:2] = (0, 1)
        score = np.clip(label * 0.4 + 0.3 + rng.normal(0, spread, n), 0, 1)
        a, b = models.sigmoid_curve(score, label, np.ones(n))
        hits, misses = label.sum(), (1 - label).sum()
        target = np.where(label == 1, (hits + 1) / (hits + 2), 1 / (misses + 2))
        off = 1 / (1 + np.exp(-(a * score + b))) - target
        assert abs(off.sum()) < 1e-6 and abs((off * score).sum()) < 1e-6


# ---- issue and severity classifiers ----------------------------------------------

def test_isotonic_curves_equal_pooling_in_order(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([round(rng.random(), 2), rng.random(), 0.0, 1.0]), 0.0, rng.choice([1.0, 2.0, 0.5])) for g in range(3)
            for _ in range(400)]
    rows = [(g, s, float(rng.random() < s), w) for g, s, _, w in rows]
    got = models.isotonic_curves(spark.createDataFrame(rows, "g int, score double, hit double, weight double"), ["g"]).collect()
    for g in range(3):
        mine = sorted({s for k, s, _, _ in rows if k == g})
        weight = np.array([sum(w for k, s, _, w in rows if (k, s) == (g, x)) for x in mine])
        total = np.array([sum(w * h for k, s, h, w in rows if (k, s) == (g, x)) for x in mine])
        sums, hits = np.concatenate([[0], weight.cumsum()]), np.concatenate([[0], total.cumsum()])
        for i, x in enumerate(mine):
            want = max(min((hits[k] - hits[j]) / (sums[k] - sums[j]) for k in range(i + 1, len(mine) + 1)) for j in range(i + 1))
            own = [r.value for r in got if r.g == g and r.low <= x <= r.high]
            assert len(own) == 1 and abs(own[0] - want) < 1e-9


def test_gradients_are_derivatives_of_the_loss():
    rng = np.random.default_rng(3)
    margins, label, weight = rng.normal(0, 1, (6, 4)), np.array([0, 1, 2, 3, 0, 1]), rng.random(6) + 0.5

    def loss(at):
        return -(weight * np.log(boosting.softmax(at)[np.arange(6), label])).sum()

    first, second = boosting.gradients(margins, label, weight)
    for i in range(6):
        for c in range(4):
            step = np.zeros((6, 4))
            step[i, c] = 1e-5
            assert abs((loss(margins + step) - loss(margins - step)) / 2e-5 - first[i, c]) < 1e-6
            assert second[i, c] >= (loss(margins + step) + loss(margins - step) - 2 * loss(margins)) / 1e-10 - 1e-3


def _class_rows(spark, classes=("a", "b", "c")):
    rows, values, _ = _rows(300, 11, len(classes))
    columns = ", ".join(f"{f} double" for f in fixed.FEATURES)
    return spark.createDataFrame([(i, classes[k], *map(float, v)) for i, (k, v) in enumerate(zip(rows.label, values))],
                                 f"snippet_id long, issue string, {columns}").cache()


def test_issue_classifier(spark, tmp_path):
    data = _class_rows(spark)
    model, report = models.train_issue_classifier(data, rounds=25, depth=3)
    found = {r["class"]: r for r in report.collect()}
    assert set(found) == {"a", "b", "c"} and sum(r.support for r in found.values()) == 60
    assert sum(r.recall * r.support for r in found.values()) > 0.7 * 60
    rows = model.predict(data).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.predicted == "abc"[int(np.argmax(r.probabilities))] for r in rows)
    model.save(str(tmp_path / "issue"))
    again = models.IssueModel.load(spark, str(tmp_path / "issue")).predict(data)
    assert sorted((r.snippet_id, r.probabilities) for r in again.collect()) == sorted((r.snippet_id, r.probabilities) for r in rows)


def test_boosting_adds_up_its_trees(spark):
    rows, values, cuts = _rows(150, 2, 3)
    nodes = boosting.boosted(spark, rows, cuts, 3, 4, 3, 0.3, 0.8, 0.5).toPandas()
    margins = np.zeros((150, 3))
    for (c, _), own in nodes.groupby(["fit", "tree"]):
        own = own.sort_values("node").reset_index()
        for i in range(150):
            at = 0
            while own.feature[at] >= 0:
                at = own.left[at] + int(values[i, own.feature[at]] > own.cut[at])
            margins[i, c] += own.votes[at][0]
    votes = trees.Votes(nodes, 3).ask(values)
    assert np.allclose(votes, margins) and nodes.depth.max() <= 3
    loss = -np.log(boosting.softmax(margins)[np.arange(150), rows.label]).mean()
    assert loss < np.log(3) * 0.8


def test_margins_are_made_again_from_the_rounds_alone():
    """A process that has seen no round, one that has seen some, and gradients class by class."""
    rows, _, _ = _rows(150, 4, 3)
    rng = np.random.default_rng(6)
    rounds = [type("Sent", (), {"value": [boosting.grow_class(rows.bins, rng.normal(0, 1, 150), rng.random(150) + 0.5, np.arange(150),
                                                               np.arange(12), 3, 0.1) for _ in range(3)]}) for _ in range(5)]
    want = sum(np.stack([boosting.tree_values(t, rows.bins) for t in r.value], axis=1) for r in rounds)
    for name, seen in (("a", 5), ("b", 2), ("b", 5), ("a", 4), ("a", 3), ("a", 5)):
        found = boosting.margins_after(name, rows.bins, 3, rounds[:seen])
    assert np.allclose(found, want)
    weight = rng.random(150)
    first, second = boosting.gradients(found, rows.label, weight)
    sums = boosting.softmax_sums(found, step=40)
    for c in range(3):
        own = boosting.class_gradients(found, *sums, c, rows.label, weight)
        assert np.array_equal(own[0], first[:, c]) and np.array_equal(own[1], second[:, c])


def test_boosted_trees_of_counted_rows_are_those_of_all_rows():
    rows, _, _ = _rows(200, 5, 2)
    rng = np.random.default_rng(1)
    count = rng.integers(0, 4, 200)
    first, second = rng.normal(0, 1, 200), rng.random(200) + 0.5
    whole = np.repeat(np.arange(200), count)
    features = np.arange(rows.bins.shape[1])
    asked = boosting.grow_class(rows.bins[whole], first[whole], second[whole], np.arange(len(whole)), features, 4, 0.1)
    found = boosting.grow_class(rows.bins, first, second, np.flatnonzero(count), features, 4, 0.1, count)
    assert len(asked["feature"]) > 5 and asked["size"][0] == count.sum()
    assert all(np.allclose(asked[k], found[k]) for k in asked)


def test_severity_classifier(spark, tmp_path):
    data = _class_rows(spark).withColumnRenamed("issue", "severity")
    model, report = models.train_severity_classifier(data, n_trees=20, depth=5)
    found = report.collect()
    assert sum(r.recall * r.support for r in found) > 1.15 * max(r.support for r in found)
    rows = model.predict(data).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in rows)
    model.save(str(tmp_path / "severity"))
    again = models.SeverityModel.load(spark, str(tmp_path / "severity")).predict(data)
    assert sorted((r.snippet_id, r.probabilities) for r in again.collect()) == sorted((r.snippet_id, r.probabilities) for r in rows)


def test_candidates_are_distinct_and_repeatable():
    def picked(seed):
        return [tuple(sorted(p.items(), key=lambda x: x[0])) for p in models.candidates(models.TrainSettings(seed=seed))]

    assert len(picked(1)) == 25 and picked(1) == picked(1) and picked(1) != picked(2)
    fits, asked = models.shared_fits("python", 5, models.candidates(models.TrainSettings()))
    served = {number for members in asked for number, *_ in members}
    assert served == set(range(25)) and len(fits) <= 5 * 8
    for fit, members in zip(fits, asked):
        assert fit.trees == max(m[1] for m in members) and fit.least_split == min(m[2] for m in members)


def test_registered_fits_are_the_full_ones(spark, sf, monkeypatch, train_rows):
    """The queries pass no smaller settings on, and one package serves all of a data folder."""
    from reviewlake.plans import catalog

    asked = []

    def train(rows, settings=None):
        assert settings is None
        asked.append("train")
        return {}, {"language_metrics": {"python": {
            "decision_threshold": 0.5, "metrics": {"f1": 0.5, "roc_auc": 0.5}, "train_size": 2, "test_size": 1,
            "best_params": {"num_trees": 3, "max_depth": None}, "best_cv_score": 0.5}}}

    def classify(data, **smaller):
        assert not smaller
        asked.append("classify")
        return None, data

    monkeypatch.setattr(catalog, "_packages", {})
    monkeypatch.setattr(catalog, "_train_rows", lambda *_: train_rows)
    monkeypatch.setattr(catalog, "_tables", lambda *_: type("T", (), {"features": None, "results": lambda self: None})())
    for name, fake in (("train_models", train), ("issue_dataset", lambda *_: None), ("severity_dataset", lambda *_: None),
                       ("train_issue_classifier", classify), ("train_severity_classifier", classify)):
        monkeypatch.setattr(models, name, fake)
    for name in ("ml_4_tuned_forest", "ml_7_per_language_train", "ml_7_per_language_train",
                 "ml_11_issue_classifier", "ml_13_severity_classifier"):
        catalog.REGISTRY[name](spark, sf)
    assert asked == ["train", "classify", "classify"]
    full = models.TrainSettings()
    assert (full.candidates, full.folds, max(full.grid["num_trees"])) == (25, 5, 700)


def test_labels_of_the_rules_need_one_review(spark, tmp_path, monkeypatch):
    """The review that gives the labels is the one that is measured by them."""
    from reviewlake.plans import flows

    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"code": c}) for c in (
        "x = 1 / 0\nprint('a long enough line')\n", "def f(a):\n    return a + 1\n", "def broken(:\n    return 12\n") * 2))
    reviews, plain = [], flows.review
    monkeypatch.setattr(flows, "review", lambda *given: reviews.append(given) or plain(*given))
    samples = flows.samples_of_files(spark, [str(tmp_path)], max_samples=None)
    found = {r.metric: r.rules for r in flows.evaluate(samples).collect()}
    assert len(reviews) == 1 and found["avg_latency_ms"] > 0
    again = {r.metric: r.rules for r in flows.evaluate(samples.select("snippet_id", "code", "label")).collect()}
    assert len(reviews) == 2 and all(found[m] == again[m] for m in found if "latency" not in m)


def test_files_without_labels(spark, tmp_path):
    """The rules label them; both classifiers are trained on them and saved."""
    from reviewlake.plans import flows

    folder = tmp_path / "samples"
    folder.mkdir()
    codes = [f"x = {i} / 0\nprint('a long enough line {i}')\n" for i in range(12)]
    codes += [f"def f{i}(a):\n    return a + {i}\n" for i in range(12)] + [f"while True:\n    print({i})\n" for i in range(12)]
    lines = [json.dumps({"code": c}) for c in [*codes, "x = 1"]]
    (folder / "a.jsonl").write_text("\n".join(lines) + "\n{broken\n")
    rows = {r.code: r.label for r in flows.samples_of_files(spark, [str(folder)]).collect()}
    assert len(rows) == 36 and {rows[c] for c in codes[:12]} == {1} and {rows[c] for c in codes[12:24]} == {0}
    (folder / "b.jsonl").write_text(json.dumps({"code": codes[0], "label": 0}) + "\n")
    assert [(r.code, r.label) for r in flows.samples_of_files(spark, [str(folder)]).collect()] == [(codes[0], 0)]
    small = {"issue": {"rounds": 3, "depth": 2}, "severity": {"n_trees": 4, "depth": 3}}
    reports = flows.train_classifiers(spark, [str(folder / "a.jsonl")], str(tmp_path / "models"), **small)
    assert {r["class"] for r in reports["issue"].collect()} >= {"Division by zero", "clean"}
    features = spark.range(1).select(*[F.lit(1).alias(f) for f in fixed.FEATURES])
    assert models.IssueModel.load(spark, str(tmp_path / "models" / "issue")).predict(features).first().predicted
    assert models.SeverityModel.load(spark, str(tmp_path / "models" / "severity")).predict(features).first().predicted
