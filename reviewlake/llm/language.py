"""Language of a text by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point. Three letters in a row are bound into one
vector: the product of the first's vector rotated by two places, the second's rotated by one and the third's. The bundle (sum)
of a text's n-grams is its profile; the bundle over texts of one language is that language's prototype. A text belongs to
the prototype with the largest cosine. Runs of anything but letters count as one separator, before and after words too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.shared import map_blocks

WIDTH = 1024
SAMPLE = 1500
"""Training texts of one language, about: the fit uses a sample of labelled rows that is bounded so."""

NO_LANGUAGE = "und"

BLOCK = 1 << 20
"""Text that a task holds at a time."""
HELD = 16_384
"""N-grams whose vectors a task holds."""
PLACES = 1 << 20
"""Places of a text whose n-grams are counted at a time."""


def letter_vectors(points: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A row of +1 and -1 for each code point (0 is the separator), from a fixed mixing of its bits."""
    x = (points.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = x + np.arange(width // 64, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = x ^ (x >> np.uint64(31))
    bits = np.unpackbits(x.view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1)


def gram_vectors(grams: np.ndarray, letters: np.ndarray, twice: np.ndarray | None = None, once: np.ndarray | None = None) -> np.ndarray:
    """Rows of three positions in ``letters`` bound into one vector each; ``twice`` and ``once`` are ``letters`` rotated so often."""
    twice = np.roll(letters, 2, axis=1) if twice is None else twice
    once = np.roll(letters, 1, axis=1) if once is None else once
    return twice[grams[:, 0]] * once[grams[:, 1]] * letters[grams[:, 2]]


class Grams:
    """Letter n-grams of a block of texts: how often each text has each of the block's distinct ones.

    Vectors are made for ``HELD`` n-grams at a time; only a block that has no more keeps them. Sums are whole numbers, so
    portions change nothing.
    """

    def __init__(self, spelled: np.ndarray, letters: np.ndarray, text: np.ndarray, gram: np.ndarray, count: np.ndarray,
                 has_letter: np.ndarray):
        self.spelled, self.letters = spelled, letters
        self.rotated = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        self.text, self.gram, self.count, self.has_letter = text, gram, count, has_letter
        self.kept = self.bound(0) if len(spelled) <= HELD else None

    def bound(self, first: int) -> np.ndarray:
        return gram_vectors(self.spelled[first:first + HELD], self.letters, *self.rotated).astype(np.float32)

    def profiles(self, first: int, last: int) -> np.ndarray:
        """Profiles of texts ``first`` to ``last`` - 1."""
        a, b = np.searchsorted(self.text, (first, last))
        text, gram, count = self.text[a:b] - first, self.gram[a:b], self.count[a:b]
        out = np.zeros((last - first, self.letters.shape[1]), np.float32)
        for start in range(0, len(self.spelled), HELD):
            own = np.flatnonzero((gram >= start) & (gram < start + HELD))
            if len(own):
                vectors = self.bound(start) if self.kept is None else self.kept
                dense = np.zeros((last - first, len(vectors)), np.float32)
                dense[text[own], gram[own] - start] = count[own]
                out += dense @ vectors
        return out


def counted(key: Callable[[int, int], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers that ``key`` gives for 0 to ``n`` - 1, and how often; ``PLACES`` at a time."""
    parts = [np.unique(key(a, min(n, a + PLACES)), return_counts=True) for a in range(0, n, PLACES)]
    if len(parts) == 1:
        return parts[0]
    values = np.concatenate([np.zeros(0, np.int64), *[v for v, _ in parts]])
    distinct, place = np.unique(values, return_inverse=True)
    return distinct, np.bincount(place, np.concatenate([np.zeros(0, np.int64), *[c for _, c in parts]]), len(distinct)).astype(np.int64)


def grams_of(texts: list[str | None], width: int) -> Grams:
    lower = ["" if t is None else t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in lower), np.int64, len(lower))
    points = np.frombuffer(("\n" + "\n\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(lower)), sizes)
    present = np.flatnonzero(np.bincount(points))
    letters = np.array([p for p in present.tolist() if chr(p).isalpha()], np.int64)
    number = np.zeros(int(present[-1]) + 1, np.int32)
    number[letters] = np.arange(1, len(letters) + 1)
    symbol = number[points]
    # One separator between words and at both ends of a text.
    stay = (symbol > 0) | np.r_[True, (symbol[:-1] > 0) | (owner[1:] != owner[:-1])]
    symbol, owner = symbol[stay], owner[stay]
    has_letter = np.zeros(len(lower), bool)
    has_letter[owner[symbol > 0]] = True
    n = len(letters) + 1

    def key(a: int, b: int) -> np.ndarray:
        one, two, three = (symbol[a + i:b + i].astype(np.int64) for i in range(3))
        whole = (owner[a:b] == owner[a + 2:b + 2]) & (one + two + three > 0)
        return (owner[a:b] * n**3 + (one * n + two) * n + three)[whole]

    both, count = counted(key, max(0, len(symbol) - 2))
    distinct, gram = np.unique(both % n**3, return_inverse=True)
    spelled = np.stack([distinct // (n * n), distinct // n % n, distinct % n], axis=1)
    return Grams(spelled, letter_vectors(np.r_[0, letters], width), both // n**3, gram, count.astype(np.float32), has_letter)


def bundles(width: int):
    def step(batch: pa.RecordBatch):
        grams = grams_of(batch.column("text").to_pylist(), width)
        langs = batch.column("lang").to_pylist()
        sums: dict[str, np.ndarray] = {}
        for at in range(0, len(langs), 256):
            part = langs[at:at + 256]
            rows = grams.profiles(at, at + len(part))
            for lang in set(part):
                mine = rows[[x == lang for x in part]].sum(axis=0, dtype=np.float64)
                sums[lang] = sums.get(lang, 0.0) + mine
        return [list(sums), [v.tolist() for v in sums.values()]]

    return step


@dataclass
class Prototypes:
    languages: list[str]
    vectors: np.ndarray

    def classify(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and the cosine of each profile; equal cosines go to the first language by name."""
        unit = self.vectors / np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-9)
        cosine = profiles @ unit.T.astype(np.float32)
        cosine /= np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)
        best = cosine.argmax(axis=1)
        return best, cosine[np.arange(len(best)), best]


def fit(documents: DataFrame, sample: int = SAMPLE, width: int = WIDTH) -> Prototypes:
    """Prototypes of the languages that ``lang`` names, from about ``sample`` texts of each, chosen by a hash of doc_id.

    Rows without a language, a text or a doc_id are not learned from.
    """
    rows = documents.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Prototypes([], np.zeros((0, width)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = rows
    if large := [r for r in counts if r["count"] > sample]:
        # Only languages that are sampled need a share; all texts of the others count.
        shares = rows.sparkSession.createDataFrame([(r.lang, sample / r["count"]) for r in large], "s_lang string, share double")
        chosen = (rows.join(F.broadcast(shares), F.col("lang") == F.col("s_lang"), "left")
                  .filter(F.col("share").isNull() | (draw < F.col("share") * (1 << 20))))
    partial = map_blocks(chosen.select("text", "lang"), "lang string, bundle array<double>", bundles, width, block=BLOCK)
    summed = (partial.select("lang", F.posexplode("bundle").alias("at", "x"))
              .groupBy("lang", "at").agg(F.sum("x").alias("x")))
    # As many rows as there are languages, of `width` numbers.
    found = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    found = sorted(((r.lang, [e.x for e in r.v]) for r in found), key=lambda r: r[0])
    return Prototypes([r[0] for r in found], np.array([r[1] for r in found]).reshape(len(found), -1))


def classifier(prototypes: Prototypes, width: int, columns: tuple[str, ...]):
    def step(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        lang, score = [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
        if prototypes.languages:
            grams = grams_of(texts, width)
            for at in range(0, len(texts), 256):
                to = min(at + 256, len(texts))
                if not grams.has_letter[at:to].any():
                    continue
                best, cosine = prototypes.classify(grams.profiles(at, to))
                for i in np.flatnonzero(grams.has_letter[at:to]).tolist():
                    lang[at + i], score[at + i] = prototypes.languages[best[i]], float(min(1, max(0, cosine[i])))
        return [*[batch.column(c) for c in columns], lang, score]

    return step


def identify(documents: DataFrame, prototypes: Prototypes, columns: str = "doc_id long") -> DataFrame:
    """``columns`` of the documents with ``lang_pred`` and ``score`` (the cosine, 0 to 1) for each whole text.

    ``und`` with score 0: a null text, one without a letter, or no language to choose from. Rows that repeat give equal rows.
    Very long texts are judged whole; an empty table gives no rows.
    """
    width = prototypes.vectors.shape[1] or WIDTH
    names = tuple(part.split()[0] for part in columns.split(", "))
    rows = documents.select(*dict.fromkeys((*names, "text")))
    return map_blocks(rows, f"{columns}, lang_pred string, score double", classifier, prototypes, width, names, block=BLOCK)


def held_out(rest: int = 1, parts: int = 3):
    """Rows that are kept out of training, by the checksum of doc_id; a null doc_id is held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(True))


def language_of_documents(documents: DataFrame) -> DataFrame:
    """Each document's language, learned from the documents that are not held out; see ``identify`` for unusual rows."""
    prototypes = fit(documents.filter(~held_out()))
    found = identify(documents, prototypes)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
