"""Token sequences of a fixed length, packed by best-two-fit.

Every document becomes its ids and one end id, cut into pieces only where it is longer than a sequence. Pieces of one length can
stand for each other, so packing needs no more than how many there are of each length: at most as many numbers as a sequence
has tokens, whatever the size of the corpus. A sequence is filled with the longest piece that still fits, until none does; then
its shortest piece gives way to two unpacked ones, if some two fit the gap (with the shortest piece taken out) more tightly.
The same filling is repeated for as long as every length in it lasts, so that fillings come as (how often, lengths). Pieces then
find their places by their number among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reviewlake.llm.shared import BLOCK_BYTES, WordTable, cut, flat_ranges, keep, running_total

LIMIT = 4096
END_ID = 1
LONG = 1000
MARKS = tuple(".,;:!?")
JOINT = re.compile("(?<=[一-鿿])(?=[、。])|(?<=[、。])(?=[一-鿿])")
"""Places in text without blanks where a word ends for certain."""


LETTERS = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
"""The letter that stands for a byte in byte-level vocabularies: printable bytes stand for themselves, the others are numbered."""
LETTERS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in LETTERS)}


NO_LEAD = bytes(range(0xC0))
MARK_ALONE = re.compile(rb"(?<![A-Za-z0-9\x80-\xbf])[.,;:!?](?=[ \t\n\r\x0b\x0c]|$)")


def spread(text: bytes) -> bytes:
    """The text in small letters and with blanks before its marks, where that is sure to leave the ids as they are.

    That is so if all is ASCII or letters of Latin-1, and marks at the end of a part follow a letter or a digit.
    """
    if (text.translate(None, NO_LEAD).strip(b"\xc3") or b"\xc3\x97" in text or b"\xc3\xb7" in text or MARK_ALONE.search(text)):
        return text
    for mark in (b".", b",", b";", b":", b"!", b"?"):
        if mark in text:
            text = text.replace(mark + b" ", b" " + mark + b" ").replace(mark + b"\n", b" " + mark + b"\n")
    return text.lower()


class Encoder:
    """Ids of blocks of texts; what has been encoded between two blanks stays known from block to block.

    No word of this tokenizer reaches over a blank, so a text's ids are those of its parts one after the other. Parts made of
    Latin-1 letters, and perhaps one mark at the end, are words for certain: they meet the tokenizer's model at once, joined by
    blanks. All others pass its normalizer and its patterns as well.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.end_id = Tokenizer.from_file(path), end_id
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts = WordTable(self.learn, self.forget, 300_000, 16 << 20)
        self.forget()

    def forget(self) -> None:
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, parts: list[bytes]) -> None:
        lengths, plain, words, others = np.zeros(len(parts), np.int64), [], [], []
        for i, part in enumerate(parts):
            if part.isalpha() and len(part) < LONG:
                plain.append(i)
                words.append(part.lower())
                continue
            text = part.decode("utf-8", "replace")
            head = text[:-1] if text[-1:] in MARKS else text
            # Letters beyond Latin-1 may change with what follows them.
            if head.isalpha() and len(head) < LONG and (head.isascii() or max(head) < "Ā"):
                word = head.lower().encode().decode("latin-1").translate(LETTERS).encode()
                plain.append(i)
                words.append(word + b" " + text[-1].encode() if text[-1] in MARKS else word)
            else:
                others.append((i, text))
        found = np.concatenate([np.zeros(0, np.uint32)] + [
            np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast(
                [b" ".join(words[a:a + 200]).decode() for a in range(0, len(words), 200)], add_special_tokens=False)])
        ends = np.flatnonzero(self.ends_word[found]) + 1
        last = np.cumsum([2 if b" " in w else 1 for w in words], dtype=np.int64) - 1
        lengths[plain] = np.diff(ends[last], prepend=0)
        rest = self.encoded([text for _, text in others])
        lengths[[i for i, _ in others]] = [len(ids) for ids in rest]
        starts = np.cumsum(lengths) - lengths
        ids = np.zeros(lengths.sum(), np.uint32)
        ids[flat_ranges(starts[plain], lengths[plain])] = found
        for (i, _), own in zip(others, rest, strict=True):
            ids[starts[i]:starts[i] + len(own)] = own
        self.starts = np.concatenate([self.starts, len(self.ids) + starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """By the whole tokenizer; the empty part stands for the end of a document."""
        short = self.library.encode_batch_fast([t if len(t) < LONG else "" for t in texts], add_special_tokens=False)
        return [[self.end_id] if not text else e.ids if len(text) < LONG else
                [i for piece in JOINT.split(text) for i in self.library.encode(piece, add_special_tokens=False).ids]
                for text, e in zip(texts, short, strict=True)]

    def block(self, texts: list[bytes], ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has; ``ended`` adds the end id to each."""
        parts, ends = [], []
        for text in texts:
            parts += spread(text).split()
            if ended:
                parts.append(b"")
            ends.append(len(parts))
        codes = self.parts.codes(parts)
        lengths = self.lengths[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[flat_ranges(self.starts[codes], lengths)], np.diff(before[np.array([0, *ends])])


def slices(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The text in order, cut at blanks after about ``size`` bytes."""
    at = 0
    while len(text) - at > size:
        ends = [p for p in (text.find(b, at + size) for b in (b" ", b"\n")) if p >= 0]
        if not ends:
            break
        yield text[at:min(ends)]
        at = min(ends)
    yield text[at:]


def cut_documents(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): one row per piece, in order of each document.

    A null or empty text is one piece with the end id alone. Rows that repeat are documents of their own, rows without a
    doc_id have pieces without one. Very long texts are encoded in slices cut at blanks; what stands between two blanks is
    one slice. Other columns are not looked at. An empty table gives no rows.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        encoder = Encoder(path, end_id)
        for batch in batches:
            for part in cut(batch, "text", BLOCK_BYTES):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
                    found = [encoder.block([s], ended=False)[0] for s in slices(texts[0])]
                    ids = np.concatenate([*found, np.array([end_id], np.uint32)])
                    counts = np.array([len(ids)])
                else:
                    ids, counts = encoder.block(texts)
                pieces = -(-counts // limit)
                owner = np.repeat(np.arange(len(counts)), pieces)
                number = flat_ranges(np.zeros(len(pieces), np.int64), pieces)
                start = number * limit
                length = np.minimum(limit, counts[owner] - start)
                first = (np.cumsum(counts) - counts)[owner] + start
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a:a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(owner)), number, start, length, crc]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                     for c, f in zip(columns, fields, strict=True)], schema=fields)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_pair(free: list[int], left: list[int], low: int, high: int) -> tuple[int, int] | None:
    """The two of the sorted lengths ``free`` (each ``left`` times) with the largest sum above ``low`` and up to ``high``.

    Of equal sums the one with the longest piece.
    """
    best, found = low, None
    i, j = 0, bisect_right(free, high) - 1
    while i <= j:
        both = free[i] + free[j]
        if both > high or (i == j and left[i] < 2):
            j -= 1
            continue
        if both > best:
            best, found = both, (free[j], free[i])
            if best == high:
                break
        i += 1
    return found


def fillings(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """How to pack ``counts`` pieces of each length: (sequences, [(length, pieces in each)]), longest length first."""
    bad = [n for n in counts if not 0 < n <= limit]
    if bad:
        raise ValueError(f"lengths must be from 1 to {limit}: {bad[:3]}")
    lengths = sorted(n for n, c in counts.items() if c)
    left = [counts[n] for n in lengths]
    out = []
    while lengths:
        used: dict[int, int] = {}
        gap, at = limit, len(lengths)
        while gap > 0:
            # The longest that fits; shorter than the one before, which no longer fits or is used up.
            at = min(at, bisect_right(lengths, gap)) - 1
            if at < 0:
                break
            take = min(left[at], gap // lengths[at])
            used[lengths[at]] = take
            gap -= take * lengths[at]
        if gap:
            least = min(used)
            free = [(n, c - used.get(n, 0)) for n, c in zip(lengths, left, strict=True) if c > used.get(n, 0)]
            pair = best_pair([n for n, _ in free], [c for _, c in free], least, gap + least)
            if pair:
                used[least] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
        used = {n: u for n, u in used.items() if u}
        place = {n: bisect_left(lengths, n) for n in used}
        times = min(left[place[n]] // u for n, u in used.items())
        out.append((times, sorted(used.items(), reverse=True)))
        for n, u in used.items():
            left[place[n]] -= times * u
        if any(left[i] == 0 for i in place.values()):
            lengths = [n for n, c in zip(lengths, left, strict=True) if c]
            left = [c for c in left if c]
    return out


def runs_of_places(filled: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The places of each length in order: a row per length and filling, sorted by length and first number."""
    rows, given, sequence = [], {}, 0
    for times, parts in filled:
        offset = 0
        for length, each in parts:
            first = given.get(length, 0)
            rows.append((length, first, sequence, each, offset))
            given[length] = first + times * each
            offset += length * each
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


def placed(length: np.ndarray, number: np.ndarray, runs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces that are the ``number``-th of their length."""
    kinds, start = np.unique(runs["length"], return_index=True)
    end = np.append(start[1:], len(runs["length"]))
    kind = np.searchsorted(kinds, length)
    low, high = start[kind], end[kind] - 1
    # Binary search for the last run that starts no later, all pieces at once.
    while (low < high).any():
        middle = (low + high + 1) // 2
        later = runs["first"][middle] > number
        low, high = np.where(later, low, middle), np.where(later, middle - 1, high)
    inside = number - runs["first"][low]
    each = runs["each"][low]
    return runs["sequence"][low] + inside // each, runs["offset"][low] + inside % each * length


def place_pieces(pieces: DataFrame, order: list[str], limit: int = LIMIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``limit``; ``order`` tells rows apart.

    Rows that agree in ``order`` and ``length`` may take each other's place. Every sequence is filled from 0 without gaps.
    The driver holds one count a length. An empty table gives no rows.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = runs_of_places(fillings(counts, limit))
    numbered = running_total(pieces.withColumn("_spread", F.xxhash64(*order)), ["length"], order, F.lit(1), "_number", "_spread")
    numbered = numbered.drop("_spread")
    schema = StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long")
    fields = to_arrow_schema(schema)
    columns = pieces.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
                places = placed(length, number, runs)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(p, pa.int64()) for p in places],
                                                 schema=fields)

    return numbered.select(*columns, "_number").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; see ``cut_documents`` for unusual rows."""
    pieces = keep(cut_documents(docs, path, limit, end_id, with_ids))
    return place_pieces(pieces, ["doc_id", "piece", "ids_crc32"], limit)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the sequences themselves, from pieces packed ``with_ids``; none is longer than the limit."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))
