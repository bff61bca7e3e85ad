"""Fingerprints of weighted terms by consistent weighted sampling.

A text's terms are its words, a term's weight is how often it occurs. For each of the samples every term has two Gamma(2, 1) numbers r
and c and a uniform b that follow from a hash of the term. With t = floor(log(weight) / r + b) and y = exp(r (t - b)) the term's
key is c / (y exp(r)), and the term with the smallest key is the sample. Two texts agree in a sample with a probability equal to the
generalised Jaccard similarity of their weights. A key follows from the sampled term and t alone, so the smallest key itself
(as a 32-bit number) stands for the sample.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reviewlake.llm.shared import WordTable, cut, keep, literal_table, map_blocks, partitions

SAMPLES = 64
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def term_hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def term_keys(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The key of each term, with its weight, in each sample."""
    seed = hashes.astype(np.uint64)[:, None] + np.arange(samples, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    uniforms = []
    for i in range(1, 6):
        bits = mixed(seed + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        uniforms.append(((bits >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -24))
    r = -np.log(uniforms[0] * uniforms[1])
    c = -np.log(uniforms[2] * uniforms[3])
    b = uniforms[4]
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    return c * np.exp(r * (b - t - 1))


class Sampler:
    """Fingerprints of blocks of texts; keys of (term, weight) pairs stay from block to block."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.forget_terms()
        self.terms = WordTable(self.learn_terms, self.forget_terms, 200_000)

    def forget_terms(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.forget_keys()

    def forget_keys(self) -> None:
        self.known = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)
        self.keys = np.zeros((0, self.samples), np.float32)

    def learn_terms(self, terms: list[str]) -> None:
        self.hashes = np.r_[self.hashes, np.fromiter(map(term_hash, terms), np.uint64, len(terms))]

    def rows_of(self, pairs: np.ndarray) -> np.ndarray:
        """Rows of ``keys`` for distinct, sorted pairs (term number times 2^32 plus weight)."""
        at = np.searchsorted(self.known, pairs)
        found = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == pairs) if len(self.known) \
            else np.zeros(len(pairs), bool)
        new = pairs[~found]
        if len(new):
            if len(self.keys) > 150_000:
                self.forget_keys()
                new = pairs
            fresh = np.concatenate([term_keys(self.hashes[p >> 32], p & 0xFFFFFFFF, self.samples)
                                    for p in np.array_split(new, 1 + len(new) // 8192)])
            known = np.r_[self.known, new]
            row = np.r_[self.row, len(self.keys) + np.arange(len(new))]
            self.keys = np.concatenate([self.keys, fresh])
            order = np.argsort(known, kind="stable")
            self.known, self.row = known[order], row[order]
            at = np.searchsorted(self.known, pairs)
        return self.row[at]

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """A row of 32-bit numbers for each text; of a text without words, all zero."""
        words, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = text.split()
            sizes[i] = len(own)
            words += own
        out = np.zeros((len(texts), self.samples), np.uint32)
        if not words:
            return out
        owner = np.repeat(np.arange(len(texts)), sizes)
        both, weight = np.unique(owner << 32 | self.terms.codes(words), return_counts=True)
        owner = both >> 32
        pairs, place = np.unique((both & 0xFFFFFFFF) << 32 | weight, return_inverse=True)
        rows = self.rows_of(pairs)[place]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        has = owner[start]
        # A few texts at a time: one row of keys for each of their terms.
        ends = np.r_[start[1:], len(rows)]
        first = 0
        while first < len(start):
            last = max(first + 1, int(np.searchsorted(ends, start[first] + 60_000, "right")))
            a, b = start[first], ends[last - 1]
            if b - a > 120_000:  # one long text
                low = np.stack([self.keys[rows[x:min(x + 60_000, b)]].min(axis=0) for x in range(a, b, 60_000)]).min(axis=0)[None]
            else:
                low = np.minimum.reduceat(self.keys[rows[a:b]], start[first:last] - a, axis=0)
            out[has[first:last]] = low.view(np.uint32)
            first = last
        return out


def as_bytes(prints: np.ndarray) -> list[bytes]:
    """Four bytes for each sample, highest first."""
    return [row.tobytes() for row in prints.astype(">u4")]


def print_step(samples: int):
    sampler = Sampler(samples)

    def step(batch: pa.RecordBatch):
        return [batch.column("doc_id"),
                [p.hex() for p in as_bytes(sampler.fingerprints([t or "" for t in batch.column("text").to_pylist()]))]]

    return step


def fingerprint(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id`` and the fingerprint of each whole text, eight hex digits for each sample (null text: the empty one's, zeros)."""
    return map_blocks(documents.select("doc_id", "text"), "doc_id long, fingerprint string", print_step, samples,
                      block=BLOCK)


class Edits:
    """Edited texts and fingerprints of rows in descending order of doc_id: a row's next document has come before it."""

    def __init__(self, samples: int):
        self.sampler = Sampler(samples)
        self.key = None
        # Text and fingerprint of the first row of the present doc_id, and of the doc_id before.
        self.present: tuple[str, np.ndarray] | None = None
        self.next: tuple[str, np.ndarray] | None = None

    def columns(self, texts: list[str], heads: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list[list]:
        edited = [t[:len(t) - len(t) // 4] + h[:len(t) // 4] for t, h in zip(texts, heads, strict=True)]
        other = self.sampler.fingerprints(edited)
        return [[len(t) for t in texts],
                [hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest() for e in edited],
                as_bytes(prints), as_bytes(other), (prints == other).mean(axis=1).tolist(),
                (prints == next_prints).mean(axis=1).tolist()]

    def block(self, keys: list[int], texts: list[str]) -> tuple[list[int], list[list]]:
        """The rows whose next document is known, and their columns; the others are the first doc_id of the partition."""
        prints = self.sampler.fingerprints(texts)
        known, heads, next_prints = [], [], []
        for i, key in enumerate(keys):
            if key != self.key:
                self.key, self.next, self.present = key, self.present, (texts[i], prints[i].copy())
            if self.next is not None:
                known.append(i)
                heads.append(self.next[0])
                next_prints.append(self.next[1])
        if not known:
            return known, []
        return known, self.columns([texts[i] for i in known], heads, prints[known], np.stack(next_prints))


DONE, WAITS, LAST = 0, 1, 2
RESULT = ("n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, "
          "near_next double")


def edit_partitions(batches, samples: int, fields: pa.Schema):
    """Rows of one range of doc_ids, in descending order: results, rows that wait for the range before, and the last document."""
    from pyspark import TaskContext

    edits, part = Edits(samples), TaskContext.get().partitionId()

    def rows(kind, ids, texts, columns):
        n = len(ids)
        columns = columns or [[None] * n] * 6
        data = [[kind] * n, [part] * n, ids, texts or [None] * n, *columns]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, fields, strict=True)], schema=fields)

    for batch in batches:
        for piece in cut(batch, "text", BLOCK):
            ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
            known, columns = edits.block(piece.column("key").to_pylist(), texts)
            if known:
                yield rows(DONE, [ids[i] for i in known], None, columns)
            if len(known) < len(ids):
                waits = sorted(set(range(len(ids))) - set(known))
                yield rows(WAITS, [ids[i] for i in waits], [texts[i] for i in waits], None)
    if edits.present is not None:
        yield rows(LAST, [edits.key], [edits.present[0]], None)


def finish_step(samples: int):
    edits = Edits(samples)

    def step(batch: pa.RecordBatch):
        texts, heads = batch.column("text").to_pylist(), batch.column("head").to_pylist()
        own, following = edits.sampler.fingerprints(texts), edits.sampler.fingerprints(heads)
        return [batch.column("doc_id"), *edits.columns(texts, heads, own, following)]

    return step


def fingerprints_and_edits(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; also the likeness to the next document.

    The edited text has its last quarter (rounded down) of code points replaced by the first as many, or all, of the next
    document's, in ascending order of doc_id; the last one's next is the first, a single one's it itself. A null text is an
    empty one. A null doc_id counts as the least number. Rows that repeat a doc_id all have the same next one, the following
    doc_id; of its rows the next document is the one with the greatest hash of its text. Two texts without words are alike
    (1.0). Other columns are not looked at. Very long texts are sampled whole; an empty table gives no rows.

    Texts are dealt out once, by ranges of doc_id. Only the first doc_id of each range needs the range before.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("key"))
    order = [F.desc("key"), F.desc(F.xxhash64("text"))]
    schema = f"kind int, part int, doc_id long, text string, {RESULT}"
    fields = to_arrow_schema(StructType.fromDDL(schema))
    ranges = rows.repartitionByRange(partitions(spark), F.desc("key")).sortWithinPartitions(*order)
    found = keep(ranges.mapInArrow(lambda batches: edit_partitions(batches, samples, fields), schema))
    # One row for each range that has documents.
    parts = sorted(r.part for r in found.filter(F.col("kind") == LAST).select("part").collect())
    before = literal_table(spark, [(p, parts[i - 1]) for i, p in enumerate(parts)], "part int, before int")
    last = found.filter(F.col("kind") == LAST).select(F.col("part").alias("before"), F.col("text").alias("head"))
    waits = (found.filter(F.col("kind") == WAITS).select("part", "doc_id", "text")
             .join(F.broadcast(before), "part").join(last, "before").select("doc_id", "text", "head"))
    names = [f.name for f in fields][4:]
    finished = map_blocks(waits, f"doc_id long, {RESULT}", finish_step, samples, block=BLOCK)
    done = found.filter(F.col("kind") == DONE).select("doc_id", *names).unionByName(finished)
    return done.select("doc_id", "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"),
                       F.lower(F.hex("fingerprint")).alias("fingerprint"),
                       F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
