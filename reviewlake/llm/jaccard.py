"""Documents linked by the Jaccard similarity of their word shingles, by blocked sparse matrix products.

The document-by-shingle incidence matrix is worked on in blocks. A document is known by the set of its shingles, so copies
are one node.

1. Blocks by shingle. Each part of the documents sends, for each block of shingle hashes, its distinct hashes there. A block
   tells every part which of its hashes other parts have too. This gives each node an upper bound for its overlap with
   any other. Nodes whose bound is too small for their size are done: nothing links with them. A shingle that a third
   of all documents have is sent once by each part, not once by each document.
2. The rest does the same once more, now among itself and with counts. What no other node has is struck out, and nodes with
   a common shingle among the rarest, those that a link cannot do without, come into one family. Families hold every
   possible link.
3. Blocks by family. A family is cut into blocks of nodes; a task multiplies two blocks of rows of the incidence matrix,
   shingle by shingle, adds up overlap counts, and keeps pairs that reach the bound that their sizes give. It returns
   links that connect what is connected, not all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.shared import keep, map_blocks, partitions

SHINGLE = 5
PERCENT = 75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
# Words are what lies between these bytes: blank, tab, line feed, vertical tab, form feed, carriage return.
BREAKS = regex.compile("[\x20\x09-\x0d]+")
PART_BYTES = 4 << 20
"""Text of one part, about."""
FILTER_BITS = 1 << 23
TILE = 1024
"""Nodes in a block of a family."""
GATHER = 1_000_000
"""Links that one task joins up, at 16 bytes each."""
PRODUCTS = 4_000_000
"""Terms of a product that are added up at once."""


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of blocks of texts; hashes of words stay from block to block, up to so many words and characters."""

    def __init__(self, width: int = SHINGLE, most: int = 150_000, longest: int = 4 << 20):
        self.width, self.most, self.longest, self.known, self.held = width, most, longest, {}, 0

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of all texts, one set after the other, and where each set ends."""
        if len(self.known) > self.most or self.held > self.longest:
            self.known, self.held = {}, 0
        words, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = [w for w in BREAKS.split(text.translate(TO_LOWER)) if w] if text else []
            sizes[i] = len(own)
            words += own
        known = self.known
        for w in dict.fromkeys(words):
            if w not in known:
                known[w] = word_hash(w)
                self.held += len(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        owner = np.repeat(np.arange(len(texts)), sizes)
        # All windows, also the short ones at the end of a text; of these only a whole short text counts.
        total, n = np.zeros(len(hashes), np.uint64), len(hashes)
        for k in range(self.width):
            part = np.zeros(n, np.uint64)
            same = np.zeros(n, bool)
            same[:n - k] = owner[k:] == owner[:n - k]
            part[:n - k] = hashes[k:]
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + np.where(same, part, np.uint64(k + 1)))
        starts = np.cumsum(sizes) - sizes
        place = np.arange(n) - np.repeat(starts, sizes)
        long = np.repeat(sizes, sizes)
        stay = (place + self.width <= long) | ((long < self.width) & (place == 0))
        owner, total = owner[stay], total[stay]
        order = np.lexsort((total, owner))
        owner, total = owner[order], total[order]
        fresh = np.ones(len(total), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
        return total[fresh], np.cumsum(np.bincount(owner[fresh], minlength=len(texts)))


def node_of(hashes: np.ndarray) -> int:
    """The name of a set: a 64-bit hash of its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(size: int | np.ndarray) -> int | np.ndarray:
    """The least overlap with anything that a set of this size can be linked with."""
    return -(-PERCENT * size // 100)


def in_blocks(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and lower 32 bits of each hash. Two hashes that agree in both are taken for one, which is seldom."""
    return ((hashes >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")


def part_name(*content: bytes) -> bytes:
    """A name of a task's block of rows, the same when the task runs again."""
    from pyspark import TaskContext

    digest = hashlib.blake2b(str(TaskContext.get().partitionId()).encode(), digest_size=16)
    for c in content:
        digest.update(c)
    return digest.digest()


def steps_of(numbers: np.ndarray) -> bytes:
    """Ascending small numbers as differences, a byte each if all fit, else four."""
    steps = np.diff(numbers, prepend=0)
    return steps.astype("u1" if steps.max(initial=0) < 256 else "<u4").tobytes()


def numbers_of(steps: bytes, count: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "u1" if len(steps) == count else "<u4"), dtype=np.int64)


def in_portions(rows: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)]


def first_step(blocks: int, deals: int):
    """Rows of one part of the documents: the documents (a negative block), and the distinct hashes in each block."""
    shingler, parts = Shingler(), iter(range(1 << 62))

    def step(batch: pa.RecordBatch):
        hashes, ends = shingler.sets(batch.column("text").to_pylist())
        sizes = np.diff(np.r_[0, ends])
        nodes = np.array([node_of(hashes[e - s:e]) if s else 0 for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)],
                         np.int64)
        # Copies within the part count as one: the first of them stands for all.
        _, first, alike = np.unique(nodes, return_index=True, return_inverse=True)
        standing = first[alike]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        use = standing[owner] == owner
        owner, hashes = owner[use], hashes[use]
        block, low = in_blocks(hashes, blocks)
        key = block << 32 | low
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.r_[start, len(key)])
        # What several nodes of the part have is shared already; what one has waits for the answer of the block.
        shared = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sizes))
        ids, missing = batch.column("doc_id").fill_null(0).to_numpy().astype("<i8"), batch.column("doc_id").is_null()
        part = part_name(str(next(parts)).encode(), ids.tobytes(), nodes.tobytes())
        documents = np.stack([ids, missing.to_numpy(zero_copy_only=False), nodes, sizes, shared, standing]).astype("<i8")
        rows = [(part, -1 - int.from_bytes(part[:4], "little") % deals, None, None, None, documents.tobytes())]
        single, key, owner = times == 1, key[start], owner[start]
        for b, x, y in runs_of(key >> 32):
            alone = single[x:y]
            mine, who = key[x:y][alone], owner[x:y][alone]
            by_owner = np.argsort(who, kind="stable")
            rows.append((part, b, mine[by_owner].astype("<u4").tobytes(), steps_of(who[by_owner]),
                         key[x:y][~alone].astype("<u4").tobytes(), None))
        return in_portions(rows)

    return step


def runs_of(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, first, end) of the runs of equal numbers."""
    start = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, np.int64)
    return list(zip(numbers[start].tolist(), start.tolist(), [*start[1:].tolist(), len(numbers)][:len(start)], strict=True))


FIRST = "part binary, block int, low binary, who binary, shared_low binary, documents binary"


def shared_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """For each part the nodes whose single hashes other parts have too, and how many such hashes each has.

    The rows of documents (negative blocks) go on as they are.
    """
    if rows.block.iloc[0] < 0:
        return rows.assign(who=None, times=None)[["part", "who", "times", "documents"]]
    low = [np.frombuffer(x, "<u4") for x in rows.low]
    every = np.sort(np.concatenate([*low, *[np.frombuffer(x, "<u4") for x in rows.shared_low]]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for part, own, who in zip(rows.part, low, rows.who, strict=True):
        hit = np.isin(own, twice, assume_unique=True) if len(twice) else np.zeros(len(own), bool)
        nodes, count = np.unique(numbers_of(who, len(own))[hit], return_counts=True)
        if len(nodes):
            out.append((part, nodes.astype("<i4").tobytes(), count.astype("<i4").tobytes(), None))
    return pd.DataFrame(out, columns=["part", "who", "times", "documents"])


def bounds_of_part(rows: pd.DataFrame) -> pd.DataFrame:
    """``doc_id, node, size, bound`` for the documents of a part."""
    own = rows.documents.dropna()
    ids, missing, nodes, sizes, shared, standing = np.frombuffer(own.iloc[0], "<i8").reshape(6, -1)
    bound = shared.copy()
    for who, times in zip(rows.who.dropna(), rows.times.dropna(), strict=True):
        np.add.at(bound, np.frombuffer(who, "<i4"), np.frombuffer(times, "<i4"))
    return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), missing.astype(bool)), "node": nodes, "size": sizes,
                         "bound": bound[standing]})


def bounded_nodes(documents: DataFrame) -> DataFrame:
    """``doc_id, node, size, bound`` of every document; ``bound``: at most so many of its shingles are in any other node."""
    deals = partitions(documents.sparkSession)
    rows = map_blocks(documents.select("doc_id", "text"), FIRST, first_step, 2 * deals, deals, block=PART_BYTES)
    found = rows.groupBy("block").applyInPandas(shared_in_block, "part binary, who binary, times binary, documents binary")
    return found.groupBy("part").applyInPandas(bounds_of_part, "doc_id long, node long, size long, bound long")


def second_step(blocks: int, deals: int):
    """Rows of one part of the nodes that are left: their sets (a negative block), and distinct hashes with their counts."""
    shingler, parts = Shingler(), iter(range(1 << 62))

    def step(batch: pa.RecordBatch):
        hashes, ends = shingler.sets(batch.column("text").to_pylist())
        sizes = np.diff(np.r_[0, ends])
        starts = ends - sizes
        nodes = np.array([node_of(hashes[a:b]) for a, b in zip(starts, ends, strict=True)], np.int64)
        # A doc_id that repeats brings other texts along.
        good = np.flatnonzero(nodes == batch.column("node").to_numpy())
        good = good[np.unique(nodes[good], return_index=True)[1]]
        hashes = np.concatenate([hashes[starts[i]:ends[i]] for i in good]) if len(good) else hashes[:0]
        nodes, sizes = nodes[good], sizes[good]
        part = part_name(str(next(parts)).encode(), nodes.tobytes())
        rows = [(part, -1 - int.from_bytes(part[:4], "little") % deals, None, None,
                 np.stack([nodes, sizes]).astype("<i8").tobytes(), hashes.astype("<u8").tobytes())]
        key, count = np.unique(np.asarray(in_blocks(hashes, blocks)[0]) << 32 | in_blocks(hashes, blocks)[1],
                               return_counts=True)
        for b, x, y in runs_of(key >> 32):
            rows.append((part, b, key[x:y].astype("<u4").tobytes(), np.minimum(count[x:y], 255).astype("u1").tobytes(),
                         None, None))
        return in_portions(rows)

    return step


SECOND = "part binary, block int, low binary, counts binary, nodes binary, sets binary"


def counts_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """For each part, how many nodes have its hashes (255: at least so many); rows of sets go on as they are."""
    if rows.block.iloc[0] < 0:
        return rows[["part", "block", "counts", "nodes", "sets"]]
    low = [np.frombuffer(x, "<u4") for x in rows.low]
    distinct, back = np.unique(np.concatenate(low), return_inverse=True)
    total = np.bincount(back, np.frombuffer(b"".join(rows.counts), "u1"), minlength=len(distinct))
    answer = np.minimum(total, 255).astype("u1")[back]
    ends = np.cumsum([len(x) for x in low])
    return rows.assign(counts=[x.tobytes() for x in np.split(answer, ends[:-1])])[["part", "block", "counts", "nodes", "sets"]]


def reduced_sets(blocks: int):
    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        """``node, size, set, prefix``: what of each set other nodes have too, and what of that a link cannot do without."""
        own = rows[rows.block < 0].iloc[0]
        nodes, sizes = np.frombuffer(own.nodes, "<i8").reshape(2, -1)
        hashes = np.frombuffer(own.sets, "<u8")
        # The answers lie in the order of block and lower bits.
        block, low = in_blocks(hashes, blocks)
        key, back = np.unique(block << 32 | low, return_inverse=True)
        asked = rows[rows.block >= 0].sort_values("block")
        count = np.frombuffer(b"".join(asked.counts), "u1")[back] if len(key) else np.zeros(0, "u1")
        out, end = [], 0
        for node, size in zip(nodes.tolist(), sizes.tolist(), strict=True):
            mine, times = hashes[end:end + size], count[end:end + size]
            end += size
            spare = int((times > 1).sum()) - needed(size)
            if spare < 0:
                continue
            # Rare hashes first: any order that all nodes have in common will do.
            order = np.lexsort((mine, times))
            order = order[times[order] > 1]
            out.append((node, size, mine[np.sort(order)].astype(np.int64), mine[order[:spare + 1]].astype(np.int64)))
        return pd.DataFrame(out, columns=["node", "size", "set", "prefix"])

    return of_part


def shared_sets(texts: DataFrame) -> DataFrame:
    """``node, size, set, prefix`` of the nodes (``node, text``) that may be linked with another of them."""
    deals = partitions(texts.sparkSession)
    rows = map_blocks(texts.select("node", "text"), SECOND, second_step, 2 * deals, deals, block=PART_BYTES)
    found = rows.groupBy("block").applyInPandas(counts_in_block, "part binary, block int, counts binary, nodes binary, sets binary")
    return found.groupBy("part").applyInPandas(reduced_sets(2 * deals), "node long, size long, set array<long>, prefix array<long>")


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links that are not the smallest one they reach, and that one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while len(x):
        left, right = label[x], label[y]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while (label[label] != label).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    led = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[led], nodes[label[led]]


def stars(frames):
    """What the links of a task connect, as a link of each node with the smallest one."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for frame in frames:
        a, b = connected(np.concatenate([a, frame["a"].to_numpy(np.int64)]), np.concatenate([b, frame["b"].to_numpy(np.int64)]))
    yield pd.DataFrame({"a": a, "b": b})


def smallest_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that can be reached over edges (``a, b``, both ways).

    Tasks first leave no more links than connect what theirs do. Up to ``GATHER`` of these one task joins up, which spares the driver the
    plans and jobs of rounds. Of more, labels are passed on: each round takes the smallest label of the neighbours, then the label's own
    label; a chain halves in every round.
    """
    edges = keep(edges.select("a", "b").mapInPandas(stars, "a long, b long"))
    if edges.count() <= GATHER:
        found = edges.coalesce(1).mapInPandas(stars, "a long, b long")
        return nodes.select("node").join(found, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("label"))
    both = keep(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(
        F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near")))
        taken = (labels.join(near, F.col("node") == F.col("a"), "left")
                 .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        target = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        after = keep(taken.join(target, F.col("label") == F.col("to"), "left")
                     .select("node", "old", F.least("label", "next").alias("label")))
        if after.filter("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


class Forest:
    """Which of some numbered nodes are connected by the links so far."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def product(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of a left and a right node) with a common hash, coded left * len(sets) + right, and their overlaps.

    The rows' entries are sorted by hash; each hash adds one to every pair of its left and right nodes. Terms are added up
    in portions, so that memory does not grow with the number of terms.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    group = np.cumsum(np.r_[0, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    is_left, is_right = np.zeros(n, bool), np.zeros(n, bool)
    is_left[left], is_right[right] = True, True
    a, b = is_left[owner], is_right[owner]
    a_owner, a_group, b_owner, b_group = owner[a], group[a], owner[b], group[b]
    groups = int(group[-1]) + 1 if len(group) else 0
    b_count = np.bincount(b_group, minlength=groups)
    b_start = np.cumsum(b_count) - b_count
    terms = b_count[a_group]
    ends = np.cumsum(terms)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    dense = len(left) * len(right) <= 4_000_000 and len(ends) and ends[-1] > 4 * PRODUCTS
    if dense:
        place = np.zeros(n, np.int64)
        place[left] = np.arange(len(left))
        column = np.zeros(n, np.int64)
        column[right] = np.arange(len(right))
        table = np.zeros(len(left) * len(right), np.int32)
    first = 0
    while first < len(a_owner):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PRODUCTS, "right")))
        many = terms[first:last]
        x = np.repeat(a_owner[first:last], many)
        y = b_owner[np.arange(int(many.sum())) + np.repeat(b_start[a_group[first:last]] - (np.cumsum(many) - many), many)]
        if dense:
            table += np.bincount(place[x] * len(right) + column[y], minlength=len(table)).astype(np.int32)
        else:
            some, times = np.unique(x * n + y, return_counts=True)
            codes, back = np.unique(np.r_[codes, some], return_inverse=True)
            counts = np.bincount(back, np.r_[counts, times], minlength=len(codes)).astype(np.int64)
        first = last
    if dense:
        at = np.flatnonzero(table)
        return left[at // len(right)] * n + right[at % len(right)], table[at].astype(np.int64)
    return codes, counts


def links_in(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
             ) -> list[tuple[int, int]]:
    """Links between left and right nodes that connect what their links connect, and links of equal effect left out."""
    n = len(nodes)
    codes, overlap = product(sets, left, right)
    x, y = codes // n, codes % n
    good = (x != y) & (100 * overlap >= PERCENT * (sizes[x] + sizes[y] - overlap))
    forest = Forest(n)
    return [(int(nodes[a]), int(nodes[b])) for a, b in zip(x[good].tolist(), y[good].tolist(), strict=True)
            if forest.join(a, b)]


def links_of_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within the small families, or the one tile of a large family, that a task gets."""
    out: list[tuple[int, int]] = []
    for (_, i, j), own in rows.groupby(["family", "i", "j"], sort=False):
        sets = [np.asarray(s, np.int64) for s in own["set"]]
        nodes, sizes = own["node"].to_numpy(np.int64), own["size"].to_numpy(np.int64)
        tile = own["tile"].to_numpy()
        out += links_in(nodes, sizes, sets, np.flatnonzero(tile == i), np.flatnonzero(tile == j))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def node_links(sets: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (``a, b``) that connect linked nodes; ``sets``: ``node, size, set, prefix``, each node once."""
    sets = keep(sets)
    entries = sets.select("node", F.explode("prefix").alias("hash"))
    # The smallest node of a hash leads the others.
    leaders = entries.groupBy("hash").agg(F.min("node").alias("leader"), F.count("*").alias("times")).filter("times > 1")
    led = (entries.join(leaders.select(F.col("hash").alias("of_hash"), "leader"), F.col("hash") == F.col("of_hash"))
           .select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    led = keep(led)
    families = keep(smallest_labels(led.select(F.col("a").alias("node")).distinct(), led))
    counts = families.groupBy(F.col("label").alias("family")).agg(F.count("*").alias("many")).filter("many > 1")
    placed = (sets.select("node", "size", "set").join(families, "node")
              .join(counts, F.col("label") == F.col("family"))
              .withColumn("tiles", F.ceil(F.col("many") / tile).cast("int"))
              .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")))
    buckets = 4 * partitions(sets.sparkSession)
    # Tiles of large families are work of their own; small families share buckets.
    bucket = F.when(F.col("tiles") > 1, F.xxhash64("family", "i", "j")).otherwise(F.pmod(F.xxhash64("family"), F.lit(buckets)))
    return (placed.withColumn("bucket", bucket).select("bucket", "family", "i", "j", "tile", "node", "size", "set")
            .groupBy("bucket").applyInPandas(links_of_bucket, "a long, b long"))


def filtered(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be among the ``of_id``s, by a bit for every value of a hash.

    The bits are one MB, whatever the number of ids, so they may be sent to every task. Where too many bits are set they hold
    nothing back, and the join behind does all the work.
    """
    def bit(column):
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1

    bits = (ids.select(F.bitmap_bucket_number(bit("of_id")).alias("bucket"), F.bitmap_bit_position(bit("of_id")).alias("at"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))
    at = F.bitmap_bit_position(bit("key"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (documents.withColumn("bucket", F.bitmap_bucket_number(bit("key"))).join(F.broadcast(bits), "bucket")
            .filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "bits"))


def id_key():
    """doc_id, of a row without one the least number."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))


def linked_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words: A-Z in lower case, cut at blanks and line ends; a set has the distinct runs of five words, of a shorter text
    the whole. Two sets are linked from 75 % of their union on. ``component_id``: the smallest doc_id that links reach.
    A text without words (null, empty, blank) has no shingles and is linked with nothing, so it has its own doc_id. Rows that
    repeat are linked like copies. A null doc_id is never the smallest one unless nothing else is reached. Sets are compared
    by 64-bit hashes of words and shingles. Other columns are not looked at. Very long texts count with all their shingles; an
    empty table gives no rows.
    """
    documents = documents.select("doc_id", "text")
    bounds = keep(bounded_nodes(documents))
    alive = bounds.filter(F.expr(f"size > 0 and 100 * bound >= {PERCENT} * size"))
    # One document of each node brings its text along. Few do, so most texts stay out of the exchange.
    wanted = keep(alive.groupBy("node").agg(F.min(id_key()).alias("of_id")))
    texts = (filtered(documents.withColumn("key", id_key()), wanted)
             .join(wanted, F.col("key") == F.col("of_id")).select("node", "text"))
    links = keep(node_links(shared_sets(texts)))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    labels = smallest_labels(nodes, links)
    named = bounds.join(labels, "node", "left").withColumn(
        "class", F.when(F.col("size") > 0, F.coalesce("label", "node")))
    # Kept apart, so that the join below does not share the sum's exchange: rows of one large class can then be split.
    smallest = keep(named.filter("class is not null").groupBy(F.col("class").alias("of_class"))
                    .agg(F.min("doc_id").alias("component_id")))
    return (named.join(smallest, F.col("class") == F.col("of_class"), "left")
            .select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
