"""SentencePiece BPE, encoding and decoding, by vectorised merge rounds.

The distinct words of a block of texts lie in one flat array of symbols. A round finds for each word the best-ranked pair of
neighbours (a segmented minimum), merges every leftmost occurrence of it at once, and squeezes the array; words
without a pair leave it. Merging all occurrences at once equals merging one by one as long as no merge makes a pair
that ranks as good or better. Where that happens (runs of spaces, above all) the word is merged one pair at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reviewlake.llm.shared import Pairs, WordTable, flat_ranges, map_blocks

SPACE = "▁"
NONE = np.iinfo(np.int32).max
BLOCK = 2 << 20

codecs.register_error("one_each", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """The vocabulary of a model file: pieces, ranks, and all pairs of symbols that make a piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        if (model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE
                or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap
                or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.escape_whitespaces
                or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces)):
            raise ValueError("only BPE models with byte fallback, without normalisation and user-defined pieces")
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        pieces = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.size = len(pieces)
        self.byte = np.zeros(256, np.int32)
        raw = []
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte[value] = i
                raw.append(bytes([value]))
            elif p.type == kind.NORMAL:
                raw.append(p.piece.replace(SPACE, " ").encode())
            else:
                raw.append(" ⁇ ".encode() if p.type == kind.UNKNOWN else b"")
        self.raw_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.opens = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.silent = np.array([p.type == kind.CONTROL for p in model.pieces])
        # Characters that only occur inside pieces are symbols too, behind the pieces.
        inside = sorted({c for p in normal for c in p} - set(normal))
        symbol = normal | {c: self.size + i for i, c in enumerate(inside)}
        self.first_other = self.size + len(inside)
        scores = sorted({-model.pieces[i].score for i in normal.values()})
        place = {s: n for n, s in enumerate(scores)}
        self.rank = np.array([place.get(-p.score, NONE) for p in model.pieces] + [NONE], np.int32)
        pairs = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in normal.items() for k in range(1, len(p))
                 if p[:k] in symbol and p[k:] in symbol]
        left, right, made = np.array(pairs, np.int64).T
        self.pairs = Pairs(left, right, made)
        self.symbol_of_point = np.full(0x110000, -1, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.symbol_of_point[ord(c)] = s
        # Where no piece goes on over a space mark, a text falls into words there.
        whole = any(SPACE in p.lstrip(SPACE) for p in normal)
        self.words = regex.compile("(?s).+" if whole else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def split(self, text: str) -> list[str]:
        return self.words.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        symbol = self.symbol_of_point[points]
        # A character without a symbol keeps its code point until it becomes bytes.
        symbol = np.where(symbol < 0, self.first_other + points, symbol).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        one_by_one: list[int] = []
        last_best = np.full(len(words), -1, np.int64)
        last_merges = np.zeros(len(words), np.int64)
        while len(symbol):
            made = np.full(len(symbol), -1, np.int32)
            made[:-1] = np.where(owner[:-1] == owner[1:], self.pairs.get(symbol[:-1], symbol[1:]), -1)
            rank = self.rank[made]
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            own = owner[start]
            best = np.minimum.reduceat(rank, start)
            count = np.diff(np.r_[start, len(symbol)])
            chosen = rank == np.repeat(best, count)
            chosen &= rank != NONE
            # Of overlapping occurrences the first, third, ... are merged.
            at = np.flatnonzero(chosen)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            merges = np.bincount(owner[at], minlength=len(words))[own]
            # Ties between different pieces, or a pair as good as the one merged before it: not all at once.
            piece_low = np.full(len(words), NONE, np.int64)
            piece_high = np.full(len(words), -1, np.int64)
            every = np.flatnonzero(chosen)
            np.minimum.at(piece_low, owner[every], made[every])
            np.maximum.at(piece_high, owner[every], made[every])
            mixed = (piece_low[own] < piece_high[own]) | ((best <= last_best[own]) & (last_merges[own] > 1))
            one_by_one += own[mixed].tolist()
            ended = (best == NONE) & ~mixed
            last_best[own], last_merges[own] = best, merges
            out = np.repeat(ended, count)
            if out.any():
                done.append((owner[out], symbol[out]))
            symbol[at] = made[at]
            stay = np.repeat(~ended & ~mixed, count)
            stay[at + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        for w in one_by_one:
            ids = self.merge_one_by_one(words[w])
            done.append((np.full(len(ids), w), ids))
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return self.as_ids(owner[order], symbol[order], len(words))

    def merge_one_by_one(self, word: str) -> np.ndarray:
        """The best-ranked pair first, of equal ones the leftmost, with a heap of pairs."""
        points = np.fromiter(map(ord, word), np.int64, len(word))
        found = self.symbol_of_point[points]
        symbol = np.where(found < 0, self.first_other + points, found).astype(np.int64)
        size = len(symbol)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []

        def offer(lefts, rights):
            made = self.pairs.get(symbol[lefts], symbol[rights])
            for a, b, m in zip(lefts, rights, made.tolist(), strict=True):
                if m >= 0:
                    heapq.heappush(heap, (int(self.rank[m]), a, b, m, int(symbol[a]), int(symbol[b])))

        offer(np.arange(size - 1), np.arange(1, size))
        alive = np.ones(size, bool)
        while heap:
            _, a, b, m, x, y = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or symbol[a] != x or symbol[b] != y or after[a] != b:
                continue
            symbol[a], alive[b] = m, False
            after[a] = after[b]
            if after[a] < size:
                before[after[a]] = a
            lefts = [int(q) for q in (before[a], a) if q >= 0 and after[q] < size]
            offer(np.array(lefts, np.int64), np.array([after[q] for q in lefts], np.int64))
        return symbol[alive]

    def as_ids(self, owner: np.ndarray, symbol: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(symbol >= self.size)
        if not len(odd):
            return symbol.astype(np.int32), np.bincount(owner, minlength=words)
        characters = {}
        for s in np.unique(symbol[odd]).tolist():
            point = s - self.first_other if s >= self.first_other else int(np.flatnonzero(self.symbol_of_point == s)[0])
            characters[s] = self.byte[np.frombuffer(chr(point).encode("utf-8", "surrogatepass"), np.uint8)]
        length = np.ones(len(symbol), np.int64)
        length[odd] = [len(characters[s]) for s in symbol[odd].tolist()]
        ids = np.repeat(symbol, length)
        starts = np.cumsum(length) - length
        for at, s in zip(starts[odd].tolist(), symbol[odd].tolist(), strict=True):
            ids[at:at + len(characters[s])] = characters[s]
        return ids.astype(np.int32), np.bincount(np.repeat(owner, length), minlength=words)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 texts of several id sequences that lie one after the other in ``ids``."""
        sizes = self.raw_size[ids]
        data = self.raw[flat_ranges(self.raw_start[ids], sizes)]
        byte_ends = np.r_[0, np.cumsum(sizes)]
        risky = np.r_[0, np.cumsum((sizes == 1) & (self.raw[self.raw_start[ids] % len(self.raw)] >= 128))]
        spoken = np.flatnonzero(~self.silent[ids])
        out, first = [], 0
        for last in ends.tolist():
            a, b = byte_ends[first], byte_ends[last]
            # The space mark that encoding puts in front goes again.
            k = np.searchsorted(spoken, first)
            if self.prefix and k < len(spoken) and spoken[k] < last and self.opens[ids[spoken[k]]]:
                a = byte_ends[spoken[k]] + 1
            text = data[a:b].tobytes()
            if risky[last] > risky[first]:
                # A control id ends a character that its bytes have not completed.
                cuts = byte_ends[first + np.flatnonzero(self.silent[ids[first:last]])]
                edges = [a, *cuts[cuts > a].tolist(), b]
                text = "".join(data[x:y].tobytes().decode("utf-8", "one_each")
                               for x, y in zip(edges, edges[1:], strict=False)).encode()
            out.append(text)
            first = last
        return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes blocks of texts; the ids of distinct words stay from block to block."""

    def __init__(self, path: str):
        self.model = piece_model(path)
        self.forget()
        self.table = WordTable(self.learn, self.forget, 200_000)

    def forget(self) -> None:
        self.ids = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, size = self.model.merge_rounds(words)
        self.ids, self.size = np.r_[self.ids, ids], np.r_[self.size, size]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, with begin and end ids, and where each text's end."""
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.model.split(text)
            counts[i] = len(own)
            words += own
        codes = self.table.codes(words)
        starts = np.cumsum(self.size) - self.size
        size = self.size[codes]
        ids = self.ids[flat_ranges(starts[codes], size)]
        ends = np.r_[0, np.cumsum(size)][np.cumsum(counts)]
        begins = np.r_[0, ends[:-1]]
        ids = np.insert(ids, np.stack([begins, ends], 1).ravel(),
                        np.tile(np.array([self.model.begin, self.model.end], np.int32), len(texts)))
        return ids, ends + 2 * np.arange(1, len(texts) + 1)


def digest_step(path: str, columns: tuple[str, ...], with_ids: bool):
    encoder = Encoder(path)

    def step(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids, ends = encoder.encode(texts)
        decoded = encoder.model.decode(ids, ends)
        begins = np.r_[0, ends[:-1]]
        raw = ids.astype("<u4")
        shas = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(begins, ends, strict=True)]
        more = [pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), ids)] if with_ids else []
        return [*[batch.column(c) for c in columns], ends - begins, shas,
                [hashlib.sha256(t).hexdigest() for t in decoded], *more]

    return step


def token_digests(documents: DataFrame, path: str, columns: str = "doc_id long", with_ids: bool = False) -> DataFrame:
    """``columns`` of each document with the number of ids of its whole text, and digests of the ids and of their decoding;
    ``with_ids`` adds the ids themselves.

    ``path``: a model file that every executor has. A null text counts as an empty one: begin and end id, nothing decoded.
    Repeated rows give equal rows, a null doc_id stays null; other columns are not looked at. A very long text is encoded whole, in a
    block of its own; an empty table gives no rows.
    """
    names = tuple(part.split()[0] for part in columns.split(", "))
    return map_blocks(documents.select(*dict.fromkeys((*names, "text"))),
                      f"{columns}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                      + ", ids array<int>" * with_ids, digest_step, path, names, with_ids, block=BLOCK)


def encode_step(path: str):
    encoder = Encoder(path)

    def step(batch: pa.RecordBatch):
        ids, ends = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
        return [batch.column("doc_id"), pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), ids)]

    return step


def encode(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ids of each whole text, with begin and end ids."""
    return map_blocks(documents.select("doc_id", "text"), "doc_id long, ids array<int>", encode_step, path, block=BLOCK)


def decode_step(path: str):
    model = piece_model(path)

    def step(batch: pa.RecordBatch):
        rows = [np.array(r or [], np.int64) for r in batch.column("ids").to_pylist()]
        ends = np.cumsum([len(r) for r in rows])
        return [batch.column("doc_id"), [t.decode() for t in model.decode(np.concatenate(rows), ends)]]

    return step


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the text of each row's ``ids`` (null or no ids: the empty text); repeated rows give equal rows.

    Ids must be the model's: one that it does not have fails the job.
    """
    return map_blocks(rows.selectExpr("doc_id", "ids", "cast('' as string) as pad"), "doc_id long, text string",
                      decode_step, path, text="pad")
