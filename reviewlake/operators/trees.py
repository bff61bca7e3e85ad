"""Forests for many fits in shared passes.

A fit is a language, a fold that is left out, and what shapes its trees (smallest leaf, features a node looks at). Fits are cut
into pieces of some trees, and one Spark job grows the pieces of all fits, each in a task that holds the fit's rows: rows with the same
bins, class and fold once, one byte a feature, and twelve bytes for each labelled row (its hash and the number of its set), from which its
draws follow. The trees of a piece grow side by side, level by level, from one histogram per level keyed by (tree, node, feature, bin, class).

How deep a tree is, how small a node may be split, and how many trees a forest has only cut off what the full forest holds: a tree's
randomness depends on (seed, tree, node) alone. Settings that differ in these only are scored from the same trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructType

BINS = 64
ENTRIES = 400_000
"""(tree, row) pairs that grow side by side in a task."""
CELLS = 2_000_000
"""Histogram cells held at a time."""
DEEPEST = 1 << 20

PORTION = 2_000_000
"""Nodes that are broadcast at a time."""

NODES = ("language string, fit int, piece int, tree int, node int, feature int, cut double, left int, size long, depth int, "
         "votes array<double>")


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# Chances that a row is drawn 0, 1, .. times, added up (Poisson with mean 1).
DRAWN = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], float))


def draws(keys: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each tree draws each row: (trees, rows)."""
    own = mixed(np.asarray(trees, np.uint64) + np.uint64(seed) * np.uint64(1 << 32) + np.uint64(1))
    bits = mixed(own[:, None] ^ keys.astype(np.uint64)[None, :])
    return np.searchsorted(DRAWN, (bits >> np.uint64(11)) * 2.0 ** -53, side="right").astype(np.uint8)


def alike(bins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of rows with the same bins and class, and the number of the set of each row."""
    table = np.ascontiguousarray(np.column_stack([bins, label]).astype(np.int32))
    _, first, number = np.unique(table.view(np.dtype((np.void, table.itemsize * table.shape[1]))).ravel(), return_index=True,
                                 return_inverse=True)
    return first, number


def drawn_alike(keys: np.ndarray, trees: np.ndarray, seed: int, number: np.ndarray) -> np.ndarray:
    """How often each tree draws the rows of each set: (trees, sets). Rows are drawn one by one, ``ENTRIES`` at a time."""
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(number.max(initial=-1) + 1))
    step, keys = max(1, ENTRIES // max(1, len(keys))), keys[order]
    return np.concatenate([np.add.reduceat(draws(keys, trees[a:a + step], seed), starts, axis=1, dtype=np.int64)
                           for a in range(0, len(trees), step)])


@dataclass
class Rows:
    """Rows of one language: a byte for each feature, the class, the fold, and a hash of the id.

    With ``number``, bins, class and fold are those of sets of rows that have them in common, the id is the set's, and ``key`` and
    ``number`` are each row's hash and set.
    """

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    ids: np.ndarray
    number: np.ndarray | None = None

    def sizes(self) -> np.ndarray:
        """How many rows each entry of ``label`` stands for."""
        return np.ones(len(self.label), np.int64) if self.number is None else np.bincount(self.number, minlength=len(self.label))

    def drawn(self, use: np.ndarray, trees: np.ndarray, seed: int, merged: np.ndarray) -> np.ndarray:
        """How often each tree draws the rows of each set ``merged`` of ``use``."""
        if self.number is None:
            return drawn_alike(self.key[use], trees, seed, merged)
        asked = (trees.tobytes(), seed)
        if getattr(self, "_asked", None) != asked:  # fits of a language share their draws, which follow from row, tree and seed alone
            self._drawn, self._asked = drawn_alike(self.key, trees, seed, self.number), asked
        order = np.argsort(merged, kind="stable")
        starts = np.searchsorted(merged[order], np.arange(merged.max(initial=-1) + 1))
        return np.add.reduceat(self._drawn[:, use[order]], starts, axis=1, dtype=np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}


@dataclass
class Forest:
    """Nodes of some trees; a node's children are ``left`` and ``left + 1``, a leaf has no feature."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    size: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    votes: list = field(default_factory=list)
    tree: list = field(default_factory=list)

    def joined(self) -> Forest:
        return Forest(*[np.concatenate(getattr(self, f)) for f in self.__dataclass_fields__])


def best_splits(starts: np.ndarray, node: np.ndarray, rows: np.ndarray, count: np.ndarray, label: np.ndarray, bins: np.ndarray,
                path: np.ndarray, weight: np.ndarray, n_features: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and last bin on the left of each node, by weighted Gini; entries are sorted by node."""
    n, classes, all_features = len(starts), weight.shape[1], bins.shape[1]
    varies = np.zeros((n, all_features), bool)
    for f in range(all_features):
        values = bins[rows, f]
        varies[:, f] = np.minimum.reduceat(values, starts) < np.maximum.reduceat(values, starts)
    # Features in an order of the node's own; those with one value only come last and are not looked at.
    order = mixed(path[:, None] + np.arange(1, all_features + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    order = np.where(varies, order >> np.uint64(1), np.uint64(1 << 63))
    looked_at = np.argsort(order, axis=1, kind="stable")[:, :n_features]
    best, feature, cut = np.full(n, -1.0), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    width = int(bins.max()) + 1 if len(bins) else 1
    per_node = np.arange(n)
    for j in range(looked_at.shape[1]):
        f = looked_at[:, j]
        value = bins[rows, f[node]]
        histogram = np.bincount((node * width + value) * classes + label, count, n * width * classes)
        left = histogram.reshape(n, width, classes).cumsum(axis=1)
        whole = left[:, -1:, :]
        left = left[:, :-1, :]
        n_left = left.sum(axis=2)
        n_right = whole.sum(axis=2) - n_left
        a, b = left * weight[:, None, :], (whole - left) * weight[:, None, :]
        a_sum, b_sum = a.sum(axis=2), b.sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (a * a).sum(axis=2) / a_sum + (b * b).sum(axis=2) / b_sum
        gain = np.where((n_left >= least) & (n_right >= least) & varies[per_node, f][:, None] & (a_sum > 0) & (b_sum > 0), gain, -1.0)
        if not gain.shape[1]:
            continue
        at = gain.argmax(axis=1)
        found = gain[per_node, at]
        better = found > best
        best[better], feature[better], cut[better] = found[better], f[better], at[better]
    return feature, cut


def grow(rows: Rows, use: np.ndarray, trees: np.ndarray, classes: int, n_features: int, least_leaf: int = 1, least_split: int = 2,
         deepest: int = DEEPEST, seed: int = 42, weight: np.ndarray | None = None) -> Forest:
    """The given trees on the rows ``use``; without ``weight`` the classes of each tree's draw weigh the same.

    Rows that no cut can part and that have the same class grow as one entry with the sum of their draws.
    """
    first, number = alike(rows.bins[use], rows.label[use])
    bins, label = rows.bins[use][first], rows.label[use][first].astype(np.int64)
    drawn = rows.drawn(use, np.asarray(trees), seed, number) if len(use) else np.zeros((len(trees), 0), np.int64)
    node, at = np.nonzero(drawn)
    count = drawn[node, at].astype(float)
    y = label[at]
    tree = np.arange(len(trees))
    path = mixed(np.asarray(trees, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    total = np.bincount(node * classes + y, count, len(trees) * classes).reshape(-1, classes)
    if weight is None:
        present = (total > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            by_tree = np.where(total > 0, total.sum(axis=1, keepdims=True) / (present * total), 0.0)
    else:
        by_tree = np.repeat(np.asarray(weight, float)[None, :], len(trees), axis=0)
    out, level, given = Forest(), 0, len(trees)
    while len(tree):
        n = len(tree)
        total = np.bincount(node * classes + y, count, n * classes).reshape(n, classes)
        size = total.sum(axis=1)
        weighted = total * by_tree[tree]
        mass = weighted.sum(axis=1, keepdims=True)
        votes = np.where(mass > 0, weighted / np.where(mass > 0, mass, 1.0), 1.0 / classes)
        feature, cut = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        open_ = np.flatnonzero((size >= max(least_split, 2 * least_leaf)) & ((total > 0).sum(axis=1) > 1)) if level < deepest else []
        if len(open_):
            number = np.full(n, -1, np.int64)
            number[open_] = np.arange(len(open_))
            kept = number[node] >= 0
            node, at, count, y = number[node[kept]], at[kept], count[kept], y[kept]
            starts = np.searchsorted(node, np.arange(len(open_)))
            step = max(1, CELLS // ((int(bins.max()) + 1) * classes))
            for a in range(0, len(open_), step):
                own = open_[a:a + step]
                c, d = starts[a], starts[a + step] if a + step < len(starts) else len(node)
                feature[own], cut[own] = best_splits(starts[a:a + step] - c, node[c:d] - a, at[c:d], count[c:d], y[c:d], bins,
                                                     path[own], by_tree[tree[own]], n_features, least_leaf)
        split = np.flatnonzero(feature >= 0)
        left = np.full(n, -1, np.int64)
        left[split] = given + 2 * np.arange(len(split))
        for name, values in (("feature", feature), ("cut", cut), ("left", left), ("size", size.astype(np.int64)),
                             ("depth", np.full(n, level)), ("votes", votes), ("tree", tree)):
            getattr(out, name).append(values)
        if not len(split):
            break
        own = open_[node]
        kept = feature[own] >= 0
        own, at, count, y = own[kept], at[kept], count[kept], y[kept]
        child = (left[own] - given) + (bins[at, feature[own]] > cut[own])
        by_node = np.argsort(child, kind="stable")
        node, at, count, y = child[by_node], at[by_node], count[by_node], y[by_node]
        tree = np.repeat(tree[split], 2)
        path = mixed(np.repeat(path[split], 2) * np.uint64(2) + np.tile(np.array([1, 2], np.uint64), len(split)))
        given += 2 * len(split)
        level += 1
    return out.joined()


def reached(forest: Forest, values: np.ndarray, n_trees: int, least_split: int = 2, deepest: int = DEEPEST) -> np.ndarray:
    """The node of each tree in which each row of ``values`` ends: (trees, rows). Roots are the first nodes."""
    inner = (forest.feature >= 0) & (forest.size >= least_split) & (forest.depth < deepest)
    node = np.repeat(np.arange(n_trees)[:, None], len(values), axis=1)
    tree, row = np.nonzero(inner[node])
    while len(tree):
        own = node[tree, row]
        own = forest.left[own] + (values[row, forest.feature[own]] > forest.cut[own])
        node[tree, row] = own
        go_on = inner[own]
        tree, row = tree[go_on], row[go_on]
    return node


# ---- the rows of the fits -------------------------------------------------------

def bin_edges(values: np.ndarray) -> np.ndarray:
    """Up to ``BINS - 1`` cuts: between all values where they are few, else between quantiles."""
    own = np.unique(values)
    if len(own) > BINS:
        own = np.unique(np.quantile(values, np.linspace(0, 1, BINS), method="nearest"))
    return (own[1:] + own[:-1]) / 2


def counted_edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``bin_edges`` of distinct ascending values that are there so many times."""
    own = values
    if len(own) > BINS:
        ranks = np.rint((counts.sum() - 1) * np.linspace(0, 1, BINS))
        own = np.unique(values[np.searchsorted(counts.cumsum(), ranks, side="right")])
    return (own[1:] + own[:-1]) / 2


def all_edges(rows: DataFrame, features: list[str]) -> dict[str, list[np.ndarray]]:
    """The cuts of each ``review_language`` and feature, from all rows. A task holds the distinct values of a feature."""
    values = rows.select("review_language", F.posexplode(F.array(*map(F.col, features))).alias("feature", "value"))
    counted = values.groupBy("review_language", "feature", "value").count()

    def edges(key, frame):
        frame = frame.sort_values("value")
        return pd.DataFrame({"review_language": [key[0]], "feature": [key[1]],
                             "cuts": [counted_edges(frame["value"].to_numpy(float), frame["count"].to_numpy(np.int64))]})

    found = counted.groupBy("review_language", "feature").applyInPandas(edges, "review_language string, feature int, cuts array<double>")
    cuts: dict[str, list[np.ndarray]] = {}
    for r in found.collect():
        cuts.setdefault(r["review_language"], [np.zeros(0)] * len(features))[r["feature"]] = np.array(r["cuts"], float)
    return cuts


KEY_PARTS = 64
"""Portions in which the hashes of a set's rows come, so that no row of a common set grows with all of them."""


def binned(rows: DataFrame, features: list[str], cuts: dict[str, list[np.ndarray]]) -> DataFrame:
    """``review_language, label, fold, snippet_id, key, bins``: a byte for each feature."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)
    schema = StructType([rows.schema[c] for c in ("review_language", "label", "fold", "snippet_id", "key")]).add("bins", BinaryType())
    fields = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            names = np.array(batch.column("review_language").to_pylist(), object)
            bins = np.zeros((batch.num_rows, len(features)), np.uint8)
            for language in set(names.tolist()):
                at = np.flatnonzero(names == language)
                for f, name in enumerate(features):
                    values = batch.column(name).to_numpy(zero_copy_only=False)
                    bins[at, f] = np.searchsorted(shared.value[language][f], values[at], side="left")
            packed = [x.tobytes() for x in bins]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-1]], pa.array(packed, pa.binary())], schema=fields)

    return rows.mapInArrow(run, schema)


def collected(rows: DataFrame, features: list[str], fold: str = "fold") -> tuple[dict[str, Rows], dict[str, list[np.ndarray]]]:
    """The rows of each ``review_language`` and the cuts between their bins.

    Rows with the same bins, class and fold come as one with the hashes of their ids, so the driver holds some bytes for each
    such set and twelve for each row.
    """
    numbers = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    given = rows.select("review_language", F.col("label").cast("int").alias("label"), F.col(fold).cast("int").alias("fold"),
                        F.col("snippet_id").cast("long").alias("snippet_id"), F.xxhash64("snippet_id").alias("key"), *numbers)
    cuts = all_edges(given, features)
    same = ["review_language", "label", "fold", "bins"]
    sets = binned(given, features, cuts).groupBy(*same, F.pmod("key", F.lit(KEY_PARTS)).alias("_part")).agg(F.collect_list("key").alias("keys"))
    table = sets.select(*same, "keys").toArrow()
    blocks = {}
    for language in sorted(cuts):
        own = table.filter(pc.equal(table["review_language"], language)).combine_chunks()
        label, fold = (own[c].to_numpy().astype(np.int32) for c in ("label", "fold"))
        bins = np.frombuffer(pa.concat_arrays(own["bins"].chunks).cast(pa.binary(len(features))).buffers()[1], np.uint8)
        bins = bins[:len(label) * len(features)].reshape(-1, len(features))
        keys = pa.concat_arrays(own["keys"].chunks)
        first, number = alike(np.column_stack([bins, fold]), label)
        blocks[language] = Rows(bins[first], label[first], fold[first], keys.flatten().to_numpy().view(np.uint64), np.arange(len(first)),
                                np.repeat(number, keys.value_lengths().to_numpy()).astype(np.int32))
    return blocks, cuts


@dataclass(frozen=True)
class Fit:
    """Trees of one shape, grown without the rows of a fold (-1: on all rows)."""

    language: str
    fold: int
    trees: int
    n_features: int
    least_leaf: int
    least_split: int = 2
    deepest: int = DEEPEST
    weight: tuple | None = None


def pieces(fits: list[Fit], blocks: dict[str, Rows]) -> list[tuple[int, int, int]]:
    """(fit, first tree, trees), each of about ``ENTRIES`` pairs of tree and set of rows that are alike."""
    out = []
    sizes = {language: len(alike(rows.bins, rows.label)[0]) for language, rows in blocks.items()}
    for i, fit in enumerate(fits):
        step = int(max(1, min(64, ENTRIES // max(1, sizes[fit.language]))))
        out += [(i, first, min(step, fit.trees - first)) for first in range(0, fit.trees, step)]
    return out


def for_pieces(spark: SparkSession, work: list[tuple[int, int, int]], fits: list[Fit], schema: str, step) -> DataFrame:
    """Run ``step(fit, first, n)``, which gives a frame or None, for each piece.

    A task gets pieces of the same trees of several fits, whose draws are the same. Each language's pieces are dealt out evenly.
    """
    tasks = max(1, min(len(work), 4 * spark.sparkContext.defaultParallelism))
    dealt: list[list] = [[] for _ in range(tasks)]
    for language in sorted({fit.language for fit in fits}):
        own = sorted((first, fit, n) for fit, first, n in work if fits[fit].language == language)
        least = sorted(range(tasks), key=lambda t: len(dealt[t]))
        for i, (first, fit, n) in enumerate(own):
            dealt[least[i * min(tasks, len(own)) // len(own)]].append((fit, first, n))

    def run(frames):
        for given in frames:
            for task in given["id"]:
                for fit, first, n in dealt[task]:
                    found = step(fit, first, n)
                    if found is not None:
                        yield found

    return spark.range(0, tasks, 1, tasks).mapInPandas(run, schema)


def grown(blocks: dict[str, Rows], fit: Fit, classes: int, first: int, n: int, seed: int) -> Forest:
    rows = blocks[fit.language]
    return grow(rows, np.flatnonzero(rows.fold != fit.fold), np.arange(first, first + n), classes, fit.n_features, fit.least_leaf,
                fit.least_split, fit.deepest, seed, None if fit.weight is None else np.array(fit.weight))


def fold_scores(spark: SparkSession, blocks: dict[str, Rows], fits: list[Fit], asked: list[list[tuple[int, int, int, int]]],
                seed: int = 42) -> DataFrame:
    """``language, candidate, fold, snippet_id, label, n, votes``: what forests say about the rows of the fold they left out.

    Rows with the same bins and class come as one row with their number ``n`` and the id of the first, or of their set.
    ``asked`` lists for each fit the candidates (number, trees, least_split, deepest) that its trees serve.
    """
    shared = spark.sparkContext.broadcast(blocks)

    def step(i, first, n):
        fit, rows = fits[i], shared.value[fits[i].language]
        out = np.flatnonzero(rows.fold == fit.fold)
        kept, number = alike(rows.bins[out], rows.label[out])
        out, alike_rows = out[kept], np.bincount(number, rows.sizes()[out], len(kept)).astype(np.int64)
        forest = grown(shared.value, fit, 2, first, n, seed)
        parts = []
        for number, trees, least_split, deepest in asked[i]:
            use = min(n, trees - first)
            if use > 0 and len(out):
                ends = reached(forest, rows.bins[out], n, least_split, deepest)[:use]
                parts.append(pd.DataFrame({"language": fit.language, "candidate": number, "fold": fit.fold, "snippet_id": rows.ids[out],
                                           "label": rows.label[out], "n": alike_rows, "votes": forest.votes[ends][:, :, 1].sum(axis=0) / trees}))
        return pd.concat(parts) if parts else None

    found = for_pieces(spark, pieces(fits, blocks), fits,
                       "language string, candidate int, fold int, snippet_id long, label int, n long, votes double", step)
    return found.groupBy("language", "candidate", "fold", "snippet_id", "label", "n").agg(F.sum("votes").alias("votes"))


def fit_forests(spark: SparkSession, blocks: dict[str, Rows], cuts: dict[str, list[np.ndarray]], fits: list[Fit], classes: int,
                seed: int = 42) -> DataFrame:
    """The nodes of all fits as a table; nodes are numbered within a piece, and its first nodes are the roots."""
    shared = spark.sparkContext.broadcast((blocks, cuts))

    def step(i, first, n):
        fit = fits[i]
        forest = grown(shared.value[0], fit, classes, first, n, seed)
        own = shared.value[1][fit.language]
        limit = [float(own[f][c]) if f >= 0 else 0.0 for f, c in zip(forest.feature, forest.cut, strict=True)]
        return pd.DataFrame({"language": fit.language, "fit": fit.fold, "piece": first, "tree": first + forest.tree,
                             "node": np.arange(len(forest.tree)), "feature": forest.feature, "cut": limit, "left": forest.left,
                             "size": forest.size, "depth": forest.depth, "votes": list(forest.votes)})

    return for_pieces(spark, pieces(fits, blocks), fits, NODES, step)


# ---- scoring ----------------------------------------------------------------------

class Votes:
    """The trees of several fits of one language, ready to be asked; built from rows of the table of nodes."""

    def __init__(self, nodes: pd.DataFrame, n_fits: int):
        nodes = nodes.sort_values(["fit", "piece", "node"], kind="stable")
        new = (nodes[["fit", "piece"]].diff() != 0).any(axis=1).to_numpy()
        offset = np.maximum.accumulate(np.where(new, np.arange(len(nodes)), 0))
        self.feature = nodes["feature"].to_numpy(np.int64)
        self.cut = nodes["cut"].to_numpy(float)
        self.left = nodes["left"].to_numpy(np.int64) + offset
        self.votes = np.array(nodes["votes"].tolist(), float)
        self.roots = np.flatnonzero(nodes["depth"].to_numpy() == 0)
        self.of_fit = nodes["fit"].to_numpy()[self.roots]
        self.n_fits = n_fits

    def ask(self, values: np.ndarray) -> np.ndarray:
        """Sums of the trees' votes: (rows, fits * classes)."""
        out = np.zeros((len(values), self.n_fits, self.votes.shape[1]))
        step = max(1, 2_000_000 // max(1, len(self.roots)))
        for a in range(0, len(values), step):
            part = values[a:a + step]
            node = np.repeat(self.roots[:, None], len(part), axis=1)
            tree, row = np.nonzero(self.feature[node] >= 0)
            while len(tree):
                own = node[tree, row]
                own = self.left[own] + (part[row, self.feature[own]] > self.cut[own])
                node[tree, row] = own
                go_on = self.feature[own] >= 0
                tree, row = tree[go_on], row[go_on]
            for fit in range(self.n_fits):
                mine = node[self.of_fit == fit]
                if len(mine):
                    out[a:a + step, fit] = self.votes[mine].sum(axis=0)
        return out.reshape(len(values), -1)


def forest_scores(rows: DataFrame, nodes: DataFrame, features: list[str], model: str, name: str = "scores") -> DataFrame:
    """Add ``name``: the mean votes of each fit for each class (fit by fit), by the trees of the language in ``model``.

    Null features count as 0. Trees are broadcast in portions of at most ``PORTION`` nodes, one pass over the rows for each;
    rows whose ``model`` has no trees get null.
    """
    spark = rows.sparkSession
    sizes = nodes.groupBy("language", "fit", "piece").agg(F.count("*").alias("n"), F.count_distinct("tree").alias("trees")).collect()
    if not sizes:
        return rows.withColumn(name, F.lit(None).cast("array<double>"))
    sizes.sort(key=lambda r: (r["language"], r["fit"], r["piece"]))
    n_fits = {r["language"]: 0 for r in sizes}
    n_trees: dict[tuple, int] = {}
    for r in sizes:
        n_fits[r["language"]] = max(n_fits[r["language"]], r["fit"] + 1)
        n_trees[r["language"], r["fit"]] = n_trees.get((r["language"], r["fit"]), 0) + r["trees"]
    portions, held = [[]], 0
    for r in sizes:
        if held + r["n"] > PORTION and portions[-1]:
            portions.append([])
            held = 0
        portions[-1].append((r["language"], r["fit"], r["piece"]))
        held += r["n"]
    columns = rows.columns
    out = rows
    for i, portion in enumerate(portions):
        own = nodes
        if len(portions) > 1:
            wanted = spark.createDataFrame(portion, "language string, fit int, piece int")
            own = nodes.join(F.broadcast(wanted), ["language", "fit", "piece"], "left_semi")
        frame = own.toPandas()
        shared = spark.sparkContext.broadcast({language: Votes(part, n_fits[language])
                                               for language, part in frame.groupby("language")})
        partial = f"_{name}_{i}"
        schema = StructType(list(out.schema.fields)).add(partial, ArrayType(DoubleType()))
        out = out.mapInArrow(_asker(shared, features, model, to_arrow_schema(schema)), schema)
    total = F.col(f"_{name}_0")
    for i in range(1, len(portions)):
        total = F.zip_with(total, F.col(f"_{name}_{i}"), lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    trees = F.create_map(*[x for language, n in n_fits.items() for x in (F.lit(language), F.array(
        *[F.lit(float(n_trees.get((language, f), 1))) for f in range(n)]))])
    of_model = F.try_element_at(trees, F.col(model))
    per_fit = (F.size(total) / F.size(of_model)).cast("int")
    mean = F.transform(total, lambda v, i: v / F.get(of_model, F.floor(i / per_fit).cast("int")))
    return out.withColumn(name, mean).select(*columns, name)


def _asker(shared, features: list[str], model: str, fields: pa.Schema):
    """Ask the trees once for each distinct row of a batch."""
    def run(batches):
        for batch in batches:
            models = batch.column(model).dictionary_encode()
            names, of_model = models.dictionary.to_pylist(), models.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            values = np.stack([np.nan_to_num(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False))
                               for f in features], axis=1) + 0.0
            first, number = alike(np.ascontiguousarray(values).view(np.int32), of_model)
            found: list = [None] * len(first)
            for language, votes in shared.value.items():
                at = np.flatnonzero(of_model[first] == names.index(language)) if language in names else []
                if len(at):
                    for i, row in zip(at.tolist(), votes.ask(values[first[at]]).tolist(), strict=True):
                        found[i] = row
            column = pa.array(found, pa.list_(pa.float64())).take(pa.array(number))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=fields)
    return run
