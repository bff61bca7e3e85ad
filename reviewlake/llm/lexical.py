"""Ranked lexical search as an exact inner-product search over sparse ball trees.

A document is a sparse vector with a whole number for each of its terms (how often the term occurs, made flat and set against the
document's length), an item is one with its terms' weights; a score is their inner product. The documents of a block form a tree
of balls: a node has a centroid and a radius, and no document below it can score more than ``item . centroid + |item| radius``
(rounded upwards). Vectors of texts lie far apart in all the terms that an item does not have, so a node also has a radius for each
term, how far above the centroid its documents reach there: ``item . (centroid + radii)`` is a bound as well, and the lower one
counts. Nodes are visited best first; a search ends when the best bound left is below the k-th score so far. Leaves are
scored exactly, in whole numbers.

For the bounds alone both vectors are scaled by the square roots of the weights, which evens them out. Blocks of a task are
searched one after the other, so that a block starts from the k-th scores of the ones before.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reviewlake.llm.shared import flat_ranges, keep, map_blocks

ITEM_BYTES = 128 << 10
"""Item text that is searched for at a time; it bounds the number of terms, and with it all that tasks hold a block."""
LEAF = 16
BLOCK_ROWS, BLOCK_TERMS = 4096, 1 << 20

# A-Z become a-z, whatever is not a digit, a letter or beyond ASCII separates terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, in order."""
    return (text or b"").translate(TABLE).split()


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts``: all terms of each document with one or more, and those of the vocabulary by number."""
    known = {term: i for i, term in enumerate(vocabulary)}

    def start():
        def step(batch):
            size, terms, counts, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = terms_of(text)
                size.append(len(found))
                inside = Counter(i for i in map(known.get, found) if i is not None)
                terms += inside.keys()
                counts += inside.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            return [batch.column("doc_id"), size, pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
        return step

    found = map_blocks(docs.select(F.col("doc_id").cast("long"), "text"),
                       "doc_id long, n long, terms array<int>, counts array<long>", start)
    return found.filter("n > 0")


def term_weights(with_term: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in with_term], np.int64)


def components(counts: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's number for a term; ``size`` is how many terms the document has."""
    if len(size) and int(size.max()) * documents < 1 << 56:
        length = 25 + 75 * size * documents // total
    else:
        length = np.array([25 + 75 * n * documents // total for n in size.tolist()], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * length)


class Items:
    """The items of a search: their terms with how often they hold each, and the vectors that follow from the weights."""

    def __init__(self, terms: list[list[int]], often: list[list[int]], weights: np.ndarray):
        self.weights, self.scale = weights, np.sqrt(weights.astype(np.float64))
        self.terms = [np.array(t, np.int64) for t in terms]
        self.exact = [np.array(o, np.int64) * weights[t] for o, t in zip(often, self.terms, strict=True)]
        self.scaled = [np.array(o, np.float64) * self.scale[t] for o, t in zip(often, self.terms, strict=True)]


class BallTree:
    """The documents of a block: rows of (position in ``ids``, term, number) in the order of the tree's leaves."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray):
        self.terms_here, local = np.unique(terms, return_inverse=True)
        self.width = len(self.terms_here)
        starts = np.cumsum(sizes) - sizes
        scaled = values * scale[terms]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        square = np.bincount(owner, scaled * scaled, len(sizes))
        order, nodes = np.arange(len(sizes)), [(0, len(sizes))]
        self.child, centroids, reach, radius = [], [], [], []
        for at, (a, b) in enumerate(nodes):
            docs = order[a:b]
            cells = flat_ranges(starts[docs], sizes[docs])
            row, column, value = np.repeat(np.arange(b - a), sizes[docs]), local[cells], scaled[cells]
            centroid = np.bincount(column, value, self.width) / (b - a)
            own = float(centroid @ centroid)
            away = square[docs] - 2 * np.bincount(row, value * centroid[column], b - a) + own
            # A distance is a difference of large squares: what rounding may have taken off is put back.
            radius.append(math.sqrt(max(float(away.max()), 0.0) + 1e-9 * (float(square[docs].max()) + own)))
            most = np.zeros(self.width)
            np.maximum.at(most, column, value)
            # 32 bits: all numbers are positive, so what is lost is a share of the bound, which is put back there.
            centroids.append(centroid.astype(np.float32))
            reach.append(most.astype(np.float32))
            self.child.append(0)
            if b - a > LEAF:
                far = self.row(docs[int(away.argmax())], starts, sizes, local, scaled)
                gap = square[docs] - 2 * np.bincount(row, value * far[column], b - a)
                other = self.row(docs[int(gap.argmax())], starts, sizes, local, scaled)
                side = np.bincount(row, value * (other - far)[column], b - a)
                order[a:b] = docs[np.argsort(side, kind="stable")]
                middle = (a + b) // 2
                self.child[at] = len(nodes)
                nodes += [(a, middle), (middle, b)]
        self.nodes, self.order = nodes, order
        # One row a term: a bound needs an item's terms only.
        self.centroids, self.reach, self.radius = np.array(centroids).T, np.array(reach).T, np.array(radius)
        cells = flat_ranges(starts[order], sizes[order])
        self.column, self.value = local[cells], values[cells]
        self.edges = np.concatenate([[0], np.cumsum(sizes[order])])

    def row(self, doc, starts, sizes, local, scaled) -> np.ndarray:
        out = np.zeros(self.width)
        cells = slice(starts[doc], starts[doc] + sizes[doc])
        out[local[cells]] = scaled[cells]
        return out

    def bounds(self, columns: np.ndarray, scaled: np.ndarray, norm: float) -> np.ndarray:
        """What no document below each node exceeds, rounded upwards."""
        high = np.minimum(scaled @ self.centroids[columns] + norm * self.radius, scaled @ self.reach[columns])
        return high * (1 + 1e-6) + 1

    def scores(self, node: int, item: np.ndarray) -> np.ndarray:
        a, b = self.nodes[node]
        c, d = self.edges[a], self.edges[b]
        products = np.concatenate([[0], np.cumsum(item[self.column[c:d]] * self.value[c:d])])
        return np.diff(products[self.edges[a:b + 1] - c])


class Search:
    """The k best documents of each item over all blocks that it is shown."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.terms]
        self.scored = self.seen = 0

    def block(self, ids: np.ndarray, no_id: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        tree = BallTree(sizes, terms, values, self.items.scale)
        where = np.full(len(self.items.weights), -1, np.int64)
        where[tree.terms_here] = np.arange(tree.width)
        exact = np.zeros(tree.width, np.int64)
        for i, own in enumerate(self.items.terms):
            here = where[own] >= 0
            if not here.any():
                continue
            columns = where[own][here]
            exact[columns] = self.items.exact[i][here]
            scaled = self.items.scaled[i][here]
            self.one(i, tree, tree.bounds(columns, scaled, math.sqrt(float(scaled @ scaled))), exact, ids, no_id)
            exact[columns] = 0
            self.seen += len(ids)

    def one(self, i: int, tree: BallTree, high: np.ndarray, exact: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score, doc, none = self.best[i]
        bar = int(score[-1]) if len(score) == self.k else 1
        queue = [(-high[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            # An equal score may still win by its id.
            if -bound < bar:
                break
            child = tree.child[node]
            if child:
                for c in (child, child + 1):
                    if high[c] >= bar:
                        heapq.heappush(queue, (-high[c], c))
                continue
            found = tree.scores(node, exact)
            self.scored += len(found)
            good = np.flatnonzero(found >= bar)
            if len(good):
                rows = tree.order[tree.nodes[node][0] + good]
                score, doc, none = (np.concatenate(pair) for pair in (
                    (score, found[good]), (doc, ids[rows]), (none, no_id[rows])))
                first = np.lexsort((doc, none, -score))[:self.k]
                score, doc, none = score[first], doc[first], none[first]
                if len(score) == self.k:
                    bar = int(score[-1])
        self.best[i] = score, doc, none


def best_in_blocks(counted: DataFrame, items: Items, documents: int, total: int, k: int) -> DataFrame:
    """``item_no, doc_id, score``: the k best of each task's documents."""
    schema = "item_no int, doc_id long, score long"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        search, held, rows, cells = Search(items, k), [], 0, 0

        def finish():
            if not held:
                return
            ids, n, terms, counts = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "n", "terms", "counts"))
            sizes = np.diff(terms.offsets.to_numpy())
            terms, counts = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            n = np.repeat(n.to_numpy(), sizes)
            search.block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), sizes, terms,
                         components(counts, n, documents, total))
            held.clear()

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK_ROWS - rows)
                lengths = np.cumsum(np.diff(part.column("terms").offsets.to_numpy()))
                fit = max(1, int(np.searchsorted(lengths, BLOCK_TERMS - cells, side="right")))
                part = part.slice(0, min(fit, part.num_rows))
                held.append(part)
                rows, cells, at = rows + part.num_rows, cells + int(lengths[part.num_rows - 1]), at + part.num_rows
                if rows >= BLOCK_ROWS or cells >= BLOCK_TERMS:
                    finish()
                    rows = cells = 0
        finish()
        for i, (score, doc, none) in enumerate(search.best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int32()), pa.array(doc, pa.int64(), mask=none),
                                                  pa.array(score, pa.int64())], schema=fields)

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(run, schema)


def search_block(docs: DataFrame, items: list[tuple], item_type: str, k: int) -> DataFrame:
    counted_items = [Counter(terms_of(text.encode("utf-8", "surrogatepass"))) for _, text in items]
    vocabulary = sorted(set().union(*counted_items))
    counted = keep(term_counts(docs, vocabulary))
    size = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    with_term = np.zeros(len(vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        with_term[row["term"]] = row["count"]
    number = {term: i for i, term in enumerate(vocabulary)}
    vectors = Items([[number[t] for t in c] for c in counted_items], [list(c.values()) for c in counted_items],
                    term_weights(with_term, size["documents"]))
    found = best_in_blocks(counted.filter(F.size("terms") > 0), vectors, size["documents"], size["total"] or 1, k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Two rounds, so that no task ranks what all others have found for an item.
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_no", part).orderBy(*order))).filter(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*order))).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)],
                                              f"item_no int, item_id {item_type}")
    return best.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring documents of each item, ties to the smaller doc_id.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``. Only scores above 0 count, so an item with fewer such
    documents has fewer rows and one without terms (null, empty) has none. Documents without terms are not counted.
    Rows that repeat are documents, or items, of their own; a document without a doc_id comes after those with the
    same score. Very long texts are counted whole. Empty tables give no rows. Other columns are not looked at.

    Items are the stated query set: they come to the driver in portions of at most ``ITEM_BYTES`` of text (or one item), each searched
    for over all documents.
    """
    asked = items.select("item_id", "text").filter(F.length("text") > 0)
    item_type = items.schema["item_id"].dataType.simpleString()
    size = int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    portions = max(1, -(-2 * size // ITEM_BYTES))
    if portions > 1:
        asked = keep(asked.withColumn("portion", F.pmod(F.xxhash64("item_id", "text"), F.lit(portions))))
    out = None
    for i in range(portions):
        rows = (asked if portions == 1 else asked.filter(F.col("portion") == i)).select("item_id", "text").collect()
        if rows:
            found = search_block(docs, [tuple(r) for r in rows], item_type, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame(
        [], f"item_id {item_type}, rank int, doc_id long, score long")
