"""Spelling variants: words one edit apart, found by scanning sorted lists with rows of the edit matrix.

The words of a sorted list that begin alike lie side by side, and the matrix rows of a query against their common beginning are the
same. A scan therefore holds ranges of the list: a range has the row of its shared beginning, of which only the three cells
around the diagonal matter for one edit. Where the adjacent words' longest common prefixes say that a range falls apart, each part
takes the row on by its next character; a part whose three cells all exceed one edit is skipped whole. All queries of a
list are scanned side by side, one character a step.

Two words one edit apart agree either in the first or in the last half of the shorter one. So each word is in lists by its
first half and, written backwards, by its last half, and no list need hold all words. Lists with very many words are cut
into portions, and each portion of queries meets each portion of the list in a task of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reviewlake.llm.shared import BLOCK_BYTES, cut, flat_ranges, keep

# Fixed values of the words: which characters they have, and which of their occurrences lose one.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOSES = 199

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
PORTION = 2048
"""Words of a list that meet in one task; longer lists are cut."""
SCANNED = 1 << 14
"""Rows of lists that a task scans at a time."""
HELD_WORDS, HELD_CHARACTERS = 200_000, 8 << 20
FAR = 9


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, n``: partial counts of the words of all texts; a task adds them up as far as its memory allows."""
    fields = to_arrow_schema(StructType.fromDDL("word string, n long"))

    def run(batches):
        counts: Counter = Counter()
        held = 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], schema=fields)

        for batch in batches:
            for part in cut(batch, "text", BLOCK_BYTES):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(),
                                     strict=True):
                    if not text:
                        continue
                    begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    # Bytes are lower-cased in ASCII only.
                    for word, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                        h = zlib.crc32(word.encode(), begun)
                        if h % LOSES == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= least_length:
                            if word not in counts:
                                held += len(word)
                            counts[word] += n
                if len(counts) > HELD_WORDS or held > HELD_CHARACTERS:
                    yield rows()
                    counts.clear()
                    held = 0
        if counts:
            yield rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")


class SortedList:
    """Lists of sorted words, one after the other; ``half`` is how many characters all words of a word's list begin with."""

    def __init__(self, words: list[str], group: np.ndarray, half: np.ndarray):
        self.words, self.half = words, half
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.cumsum(self.length) - self.length
        edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
        sizes = np.diff(np.append(edges, len(words)))
        self.low, self.high = np.repeat(edges, sizes), np.repeat(edges + sizes, sizes)
        # Where a list falls apart after so many common characters: (characters, row), sorted.
        inside = np.setdiff1d(np.arange(len(words)), edges)
        self.rows = len(words) + 1
        self.apart = np.sort(self.common_prefix(inside) * self.rows + inside)

    def char(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The character there, or 0 outside the word."""
        good = (place >= 0) & (place < self.length[word])
        return np.where(good, self.chars[np.where(good, self.at[word] + place, 0)], 0)

    def common_prefix(self, rows: np.ndarray) -> np.ndarray:
        """How many characters each of these rows shares with the one before."""
        out = np.minimum(self.half[rows], np.minimum(self.length[rows], self.length[rows - 1]))
        open_ = np.arange(len(rows))
        while len(open_):
            r, d = rows[open_], out[open_]
            same = (d < self.length[r]) & (d < self.length[r - 1])
            same &= self.char(r, d) == self.char(r - 1, d)
            open_ = open_[same]
            out[open_] += 1
        return out

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of words at a distance of exactly one edit."""
        q, low, high, depth = queries, self.low[queries], self.high[queries], self.half[queries]
        # Cells of the row: query prefixes one shorter than, as long as, and one longer than the words' shared beginning.
        a, b, c = (np.full(len(q), v) for v in (1, 0, 1))
        c[self.length[q] == depth] = FAR
        while len(q):
            # A word that is no longer than the beginning comes first in its range.
            ends = np.flatnonzero(self.length[low] == depth)
            gap = self.length[q[ends]] - depth[ends]
            distance = np.choose(np.clip(gap + 1, 0, 3), [a[ends], b[ends], c[ends], np.full(len(ends), FAR)])
            hit = ends[(distance == 1) & (gap >= -1)]
            yield q[hit], low[hit]
            low = low.copy()
            low[ends] += 1
            left = np.flatnonzero(low < high)
            q, low, high, depth, a, b, c = (x[left] for x in (q, low, high, depth, a, b, c))
            # Cut the ranges where the next character changes.
            first = np.searchsorted(self.apart, depth * self.rows + low, side="right")
            count = np.searchsorted(self.apart, depth * self.rows + high) - first
            cuts = self.apart[flat_ranges(first, count)] % self.rows
            part = np.repeat(np.arange(len(q)), count + 1)
            begin = np.ones(len(part), bool)
            begin[1:] = part[1:] != part[:-1]
            starts, ends = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            starts[begin], starts[~begin] = low, cuts
            last = np.ones(len(part), bool)
            last[:-1] = begin[1:]
            ends[last], ends[~last] = high, cuts
            q, low, high, depth, a, b, c = q[part], starts, ends, depth[part], a[part], b[part], c[part]
            next_ = self.char(low, depth)
            size = self.length[q]
            a2 = np.minimum(a + (next_ != self.char(q, depth - 1)), b + 1)
            b2 = np.minimum(np.minimum(b + (next_ != self.char(q, depth)), c + 1), a2 + 1)
            c2 = np.minimum(c + (next_ != self.char(q, depth + 1)), b2 + 1)
            a2[depth > size] = FAR
            b2[depth + 1 > size] = FAR
            c2[depth + 2 > size] = FAR
            good = np.flatnonzero(np.minimum(np.minimum(a2, b2), c2) <= 1)
            q, low, high, depth, a, b, c = q[good], low[good], high[good], depth[good] + 1, a2[good], b2[good], c2[good]


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: each word with every other one that is one edit away; ``words``: distinct ``word``, ``n``.

    Words of one character or none have no half to look under and are not compared.
    """
    half = F.expr("length(word) div 2")
    shorter = F.expr("(length(word) - 1) div 2")
    halves = F.array_distinct(F.array(half, shorter))
    lists = (words.filter(F.length("word") > 1).select("word", "n", F.explode(halves).alias("half")).filter("half > 0")
             .select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward")))
    lists = lists.withColumn("text", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))).select(
        "backward", "half", F.expr("substring(text, 1, half)").alias("key"), "text", "n")
    key = ["backward", "half", "key"]
    large = lists.groupBy(*key).count().filter(F.col("count") > PORTION).select(
        *key, F.ceil(F.col("count") / PORTION).cast("int").alias("portions"))
    own = F.pmod(F.xxhash64("text"), F.coalesce("portions", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("portions", F.lit(1)) - 1))
    dealt = lists.join(large, key, "left").withColumn("own", own).withColumn("other", other)
    # As a query, and as a word of the list; both at once where the portions are the same.
    asks = dealt.select(*key, F.col("own").alias("queries"), F.col("other").alias("listed"), "text", "n", F.lit(True).alias("asks"),
                        (F.col("own") == F.col("other")).alias("answers"))
    answers = dealt.filter("own <> other").select(*key, F.col("other").alias("queries"), F.col("own").alias("listed"), "text", "n",
                                                  F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    cell = ["backward", "half", "queries", "listed", "key"]
    schema = "word string, near string, near_n long"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def scan(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        text, n = rows["text"].to_pylist(), rows["n"].to_numpy()
        backward, asks, answers = (rows[c].to_numpy() for c in ("backward", "asks", "answers"))
        length = rows["half"].to_numpy().astype(np.int64)
        found = SortedList(text, starts_of_lists(rows).cumsum(), length)
        for a in range(0, len(text), SCANNED):
            for query, row in found.near(np.flatnonzero(asks[a:a + SCANNED]) + a):
                here = answers[row] & (np.minimum(found.length[query], found.length[row]) // 2 == length[query])
                out = []
                for q, r in zip(query[here].tolist(), row[here].tolist(), strict=True):
                    word, near = text[q], text[r]
                    if backward[q]:
                        # Found by their first halves as well.
                        if word[-length[q]:] == near[-length[q]:]:
                            continue
                        word, near = word[::-1], near[::-1]
                    out.append((word, near, int(n[r])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), fields, strict=True)],
                                                     schema=fields)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SCANNED:
                rows = pa.Table.from_batches(held).combine_chunks()
                # The last list may go on in the next batch.
                end = int(np.flatnonzero(starts_of_lists(rows))[-1])
                if end:
                    yield from scan(rows.slice(0, end).combine_chunks())
                held = rows.slice(end).combine_chunks().to_batches()
        if held:
            yield from scan(pa.Table.from_batches(held).combine_chunks())

    def starts_of_lists(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in cell:
            column = rows[c].combine_chunks()
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        return new

    return (asks.unionByName(answers).select(*cell, "text", "n", "asks", "answers").repartition(*cell)
            .sortWithinPartitions(*cell, "text").mapInArrow(run, schema))


def with_forms(words: DataFrame, near: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """Add ``form, root, n_near, form_n`` to ``word, n``.

    A form is at least ``ratio`` times as frequent as its word, so chains of forms are short: their length is at most
    the logarithm of the largest n, and doubling the steps takes the logarithm of that many rounds.
    """
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = keep(words.join(best, "word", "left")
                  .withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n",
                          F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form")))
    most = judged.agg(F.max("n")).first()[0] or 1
    steps, reach = 1, ratio
    while reach <= most:
        steps, reach = steps + 1, reach * ratio
    roots = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    done = 1
    while done < steps:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = keep(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        done *= 2
    return judged.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"),
                                                     "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      ratio: int = FORM_RATIO) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` for each word of the texts that is long and frequent enough.

    Null and empty texts have no words; a row without a doc_id counts like one whose doc_id is the empty text. Rows that
    repeat are counted each time. Of near words with equal n the smallest in code-point order is the form. Very long
    texts and words are taken whole. Other columns are not looked at. An empty table gives no rows.
    """
    words = keep(counted_words(docs, least_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))
    return with_forms(words, near_words(words), ratio)
