"""Multiclass boosting on softmax gradients: in each round one tree per class, all from the same binned rows.

All rows are grown on, rows with the same bins and class as one, a byte a feature. A round is one Spark job with a task for each class, which grows the class's
tree level by level from one histogram of gradients keyed by (node, feature, bin); the trees of a round come back as some dozens of
nodes each. They are all that is sent to the next round: Python workers keep the margins that the gradients follow from, and add to them the
rounds that they have not seen yet.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from reviewlake.operators.trees import NODES, Rows, alike, mixed

SMOOTHING = 1.0
"""Added to the sum of second derivatives of a leaf."""
LEAST_BEND = 1.0
"""Least sum of second derivatives on each side of a split."""
TASK_ROWS = 50_000
"""Distinct rows, once for each class, that are worth a task of their own."""


def softmax(margins: np.ndarray) -> np.ndarray:
    grown = np.exp(margins - margins.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log loss by each margin; the second are twice the diagonal's, a safe bound."""
    p = softmax(margins)
    first = p.copy()
    first[np.arange(len(label)), label] -= 1
    return first * weight[:, None], np.maximum(2 * p * (1 - p), 1e-16) * weight[:, None]


def class_gradients(margins: np.ndarray, most: np.ndarray, total: np.ndarray, c: int, label: np.ndarray, weight: np.ndarray
                    ) -> tuple[np.ndarray, np.ndarray]:
    """``gradients`` of one class, by the rows' ``softmax_sums``."""
    p = np.exp(margins[:, c] - most) / total
    return (p - (label == c)) * weight, np.maximum(2 * p * (1 - p), 1e-16) * weight


def softmax_sums(margins: np.ndarray, step: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Each row's largest margin and sum of exponentials, ``step`` rows at a time."""
    most = margins.max(axis=1)
    parts = [np.exp(margins[a:a + step] - most[a:a + step, None]).sum(axis=1) for a in range(0, len(margins), step)]
    return most, np.concatenate([np.zeros(0), *parts])


_held: dict = {"name": None}


def margins_after(name: str, bins: np.ndarray, classes: int, rounds: list) -> np.ndarray:
    """The margins after all ``rounds`` (broadcasts of trees by class); this process keeps them for the rounds that follow."""
    if _held["name"] != name or _held["turn"] > len(rounds):
        _held.update(name=name, turn=0, margins=np.zeros((len(bins), classes)))
    while _held["turn"] < len(rounds):
        for c, tree in enumerate(rounds[_held["turn"]].value):
            _held["margins"][:, c] += tree_values(tree, bins)
        _held["turn"] += 1
    return _held["margins"]


def chance(keys: np.ndarray, number: int) -> np.ndarray:
    """A fixed number from 0 to 1 for each key."""
    bits = mixed(keys.astype(np.uint64) ^ mixed(np.array([number], np.uint64)))
    return (bits >> np.uint64(11)) * 2.0 ** -53


def grow_class(bins: np.ndarray, first: np.ndarray, second: np.ndarray, use: np.ndarray, features: np.ndarray, depth: int,
               rate: float, count: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """One tree: ``feature`` (-1: leaf), ``cut`` (last bin on the left), ``left``, ``depth``, ``value`` of each node.

    With ``count`` a row stands for so many, and its derivatives are those of one of them.
    """
    if count is None:
        count = np.ones(len(bins), np.int64)
    first, second = first * count, second * count
    width = int(bins.max(initial=0)) + 1
    node = np.zeros(len(use), np.int64)
    rows, given, out = use, 1, []
    for level in range(depth + 1):
        n = int(node.max(initial=-1)) + 1 if level else 1
        g, h = np.bincount(node, first[rows], n), np.bincount(node, second[rows], n)
        feature, cut = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if level < depth and width > 1:
            best = np.full(n, 1e-9)
            for f in features:
                cell = node * width + bins[rows, f]
                left_g = np.bincount(cell, first[rows], n * width).reshape(n, width).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(cell, second[rows], n * width).reshape(n, width).cumsum(axis=1)[:, :-1]
                right_g, right_h = g[:, None] - left_g, h[:, None] - left_h
                gain = (left_g ** 2 / (left_h + SMOOTHING) + right_g ** 2 / (right_h + SMOOTHING)
                        - (g ** 2 / (h + SMOOTHING))[:, None])
                gain = np.where((left_h >= LEAST_BEND) & (right_h >= LEAST_BEND), gain, -1.0)
                at = gain.argmax(axis=1)
                found = gain[np.arange(n), at]
                better = found > best
                best[better], feature[better], cut[better] = found[better], f, at[better]
        split = np.flatnonzero(feature >= 0)
        left = np.full(n, -1, np.int64)
        left[split] = given + 2 * np.arange(len(split))
        out.append({"feature": feature, "cut": cut, "left": left, "depth": np.full(n, level), "value": -rate * g / (h + SMOOTHING),
                    "size": np.bincount(node, count[rows], n).astype(np.int64)})
        if not len(split):
            break
        kept = feature[node] >= 0
        rows, node = rows[kept], node[kept]
        node = left[node] - given + (bins[rows, feature[node]] > cut[node])
        given += 2 * len(split)
    return {k: np.concatenate([o[k] for o in out]) for k in out[0]}


def tree_values(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    at = np.flatnonzero(tree["feature"][node] >= 0)
    while len(at):
        own = node[at]
        node[at] = tree["left"][own] + (bins[at, tree["feature"][own]] > tree["cut"][own])
        at = at[tree["feature"][node[at]] >= 0]
    return tree["value"][node]


TREE = "class int, feature array<int>, cut array<int>, left array<int>, depth array<int>, value array<double>, size array<int>"


def boosted(spark: SparkSession, rows: Rows, cuts: list[np.ndarray], classes: int, rounds: int, depth: int, rate: float,
            subsample: float, features_a_tree: float, seed: int = 42) -> DataFrame:
    """The nodes of all rounds and classes in the layout of ``trees.NODES``: a class is a fit, a round is a tree with one vote.

    Classes weigh the same. A round draws its share of rows, a tree its share of features, by hashes of (seed, round, class).
    Rows with the same bins and class have the same margins, so trees grow on one of them with the number that the round drew.
    """
    kept, number = alike(rows.bins, rows.label)
    own_bins, own_label = rows.bins[kept], rows.label[kept]
    number = (number if rows.number is None else number[rows.number]).astype(np.int32)
    counts = np.bincount(own_label[number], minlength=classes)
    weight = (len(number) / np.maximum(1, classes * counts))[own_label]
    n_features = max(1, int(round(features_a_tree * rows.bins.shape[1])))
    shared = spark.sparkContext.broadcast((own_bins, own_label, weight, rows.key, number))
    tasks = max(1, min(classes, spark.sparkContext.defaultParallelism, len(kept) * classes // TASK_ROWS))
    out, done, name = [], [], uuid.uuid4().hex
    for turn in range(rounds):

        def step(frames, done=tuple(done), turn=turn):
            bins, label, weights, keys, number = shared.value
            margins = margins_after(name, bins, classes, done)
            most, total = softmax_sums(margins)
            count = np.bincount(number[chance(keys, seed * 1_000_003 + turn) < subsample], minlength=len(bins))
            use = np.flatnonzero(count)
            for given in frames:
                found = []
                for c in given["id"]:
                    order = chance(np.arange(bins.shape[1]), (seed * 1_000_003 + turn) * 1009 + int(c) + 1)
                    own = np.sort(np.argsort(order, kind="stable")[:n_features])
                    first, second = class_gradients(margins, most, total, int(c), label, weights)
                    tree = grow_class(bins, first, second, use, own, depth, rate, count)
                    found.append({"class": int(c), **{k: v.tolist() for k, v in tree.items()}})
                yield pd.DataFrame(found, columns=["class", "feature", "cut", "left", "depth", "value", "size"])

        found = sorted(spark.range(0, classes, 1, tasks).mapInPandas(step, TREE).collect(), key=lambda r: r["class"])
        grown = [{k: np.array(r[k]) for k in ("feature", "cut", "left", "depth", "value", "size")} for r in found]
        done.append(spark.sparkContext.broadcast(grown))
        for c, tree in enumerate(grown):
            limit = [float(cuts[f][c_]) if f >= 0 else 0.0 for f, c_ in zip(tree["feature"], tree["cut"], strict=True)]
            out.append(pd.DataFrame({"language": "", "fit": c, "piece": turn, "tree": turn, "node": np.arange(len(limit)),
                                     "feature": tree["feature"], "cut": limit, "left": tree["left"], "size": tree["size"],
                                     "depth": tree["depth"], "votes": [[float(v)] for v in tree["value"]]}))
    for sent in done:
        sent.destroy()
    return spark.createDataFrame(pd.concat(out), NODES)
