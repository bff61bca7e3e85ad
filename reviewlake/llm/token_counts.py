"""Token counts of byte-level BPE by dynamic programming over prefixes.

For every prefix of a word there is one token that its encoding ends with. It is the longest token t ending there such that the
last token before it and t stand side by side in an encoding, which the merge ranks decide for the two alone. So one pass
over the bytes gives the exact token count of every prefix, without merging anything. All distinct words of a block of
texts go through that pass together, byte by byte.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reviewlake.llm.shared import Pairs, WordTable, map_blocks

# How byte-level BPE cuts a text into words, and the characters that stand for bytes in vocabulary files.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

LONG = 256
NEVER = np.iinfo(np.int32).max


def byte_of_character() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens numbered by rank: 0 to 255 the bytes, then the merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte = byte_of_character()
        pieces = [bytes([b]) for b in range(256)]
        number = {p: i for i, p in enumerate(pieces)}
        left, right = [], []
        for merge in model["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = bytes(byte[c] for c in a), bytes(byte[c] for c in b)
            left.append(number[a])
            right.append(number[b])
            number[a + b] = len(pieces)
            pieces.append(a + b)
        merged = np.arange(256, len(pieces))
        self.left = np.r_[np.arange(256), left].astype(np.int32)
        self.right = np.r_[np.arange(256), right].astype(np.int32)
        self.merges = Pairs(self.left[256:], self.right[256:], merged)
        self.made = dict(zip(zip(left, right, strict=True), merged.tolist(), strict=True))
        self.checked: dict[tuple[int, int], bool] = {}
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        self.build_trie(pieces)

    def build_trie(self, pieces: list[bytes]) -> None:
        step: dict[tuple[int, int], int] = {}
        token = [-1]
        for i, piece in enumerate(pieces):
            at = 0
            for b in piece:
                to = step.get((at, b))
                if to is None:
                    to = step[at, b] = len(token)
                    token.append(-1)
                at = to
            token[at] = i
        self.children, self.ends = step, token
        keys = np.array(list(step), np.int64)
        self.step = Pairs(keys[:, 0], keys[:, 1], np.fromiter(step.values(), np.int64, len(step)))
        self.token = np.array(token, np.int32)

    def side_by_side(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the encoding of both tokens' bytes is these two tokens.

        Seen backwards in time: the later made of the two is taken apart, and its part at the border must not have been
        merged with the other one before it was made itself.
        """
        good = np.ones(len(first), bool)
        todo = np.arange(len(first))
        a, b = first.astype(np.int32), second.astype(np.int32)
        until = np.full(len(first), NEVER, np.int32)
        while len(todo):
            made = self.merges.get(a, b)
            bad = (made >= 0) & (made < until)
            good[todo[bad]] = False
            go = ~bad & (np.maximum(a, b) >= 256)
            todo, a, b = todo[go], a[go], b[go]
            first_later = a > b
            # Merges of one kind are made from left to right, so the second one's own merge is late by one.
            until = np.where(first_later, a, b + 1)
            a, b = np.where(first_later, self.right[a], a), np.where(first_later, b, self.left[b])
        return good

    def two_side_by_side(self, a: int, b: int) -> bool:
        """The same for one pair, remembered."""
        known = self.checked.get((a, b))
        if known is not None:
            return known
        if len(self.checked) > 500_000:
            self.checked.clear()
        x, y, until, good = a, b, NEVER, True
        while good:
            good = self.made.get((x, y), NEVER) >= until
            if max(x, y) < 256:
                break
            if x > y:
                x, until = int(self.right[x]), x
            else:
                y, until = int(self.left[y]), y + 1
        self.checked[a, b] = good
        return good

    def counts_of_long(self, word: bytes) -> np.ndarray:
        """Token counts of all prefixes of one long word."""
        tokens: list[list[tuple[int, int]]] = [[] for _ in word]
        for begin in range(len(word)):
            at = 0
            for i in range(begin, len(word)):
                at = self.children.get((at, word[i]))
                if at is None:
                    break
                if self.ends[at] >= 0:
                    tokens[i].append((begin, self.ends[at]))
        last, count = [0] * len(word), [0] * len(word)
        for i, found in enumerate(tokens):
            # Longest first, as it begins first.
            for begin, t in found:
                if begin == 0 or self.two_side_by_side(last[begin - 1], t):
                    last[i], count[i] = t, (count[begin - 1] if begin else 0) + 1
                    break
        return np.array(count, np.int64)

    def prefix_counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of all prefixes of all words, one after the other, and where each word's begin.

        Words of up to LONG bytes go through the pass together, byte by byte; a longer one by itself.
        """
        if any(len(w) > LONG for w in words):
            short, _ = self.prefix_counts([w for w in words if len(w) <= LONG])
            ends = np.cumsum([len(w) for w in words if len(w) <= LONG])
            parts = iter(np.split(short, ends[:-1]) if len(ends) else [])
            sizes = np.array([len(w) for w in words])
            return (np.concatenate([self.counts_of_long(w) if len(w) > LONG else next(parts) for w in words]),
                    np.cumsum(sizes) - sizes)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.int64), start
        end = np.repeat(start + sizes, sizes)
        # Every token at every place of a word.
        at, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        begins, ends, tokens, length = [], [], [], 0
        while len(at):
            inside = at + length < end[at]
            at, node = at[inside], node[inside]
            node = self.step.get(node, data[at + length])
            at, node = at[node >= 0], node[node >= 0].astype(np.int64)
            length += 1
            token = self.token[node]
            begins.append(at[token >= 0])
            ends.append(begins[-1] + length)
            tokens.append(token[token >= 0])
        begin, stop, token = np.concatenate(begins), np.concatenate(ends), np.concatenate(tokens)
        # By number of bytes of the prefix, then longest token first.
        prefix = stop - np.repeat(start, sizes)[begin]
        order = np.lexsort((stop - begin, -(stop - begin), prefix))
        begin, stop, token, prefix = begin[order], stop[order], token[order], prefix[order]
        groups = np.flatnonzero(np.r_[True, (np.diff(prefix) != 0) | (np.diff(stop - begin) != 0)]) if len(prefix) else []
        count, last = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int32)
        first = np.zeros(len(data), bool)
        first[start[sizes > 0]] = True
        for x, y in zip(groups, [*groups[1:], len(prefix)], strict=True):
            b, e, t = begin[x:y], stop[x:y] - 1, token[x:y]
            free = last[e] < 0
            b, e, t = b[free], e[free], t[free]
            whole = first[b]
            fits = whole.copy()
            rest = np.flatnonzero(~whole)
            fits[rest] = self.side_by_side(last[b[rest] - 1], t[rest])
            b, e, t, whole = b[fits], e[fits], t[fits], whole[fits]
            last[e] = t
            count[e] = np.where(whole, 1, count[np.maximum(b - 1, 0)] + 1)
        return count, start


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass
class Counted:
    """A text's words with the token count and bytes before each of them, for questions about budgets."""

    words: list[bytes]
    inside: list[np.ndarray]
    before: np.ndarray
    offset: np.ndarray

    def total(self) -> int:
        return int(self.before[-1])

    def longest_prefix(self, budget: int) -> int:
        """Bytes of the longest prefix, cut at a word or inside one, whose words so far take no more than ``budget`` tokens.

        Counts inside a word may fall again with a further byte; the longest fitting prefix is meant.
        """
        w = int(np.searchsorted(self.before, budget, "right")) - 1
        if w >= len(self.words):
            return int(self.offset[-1])
        fits = np.flatnonzero(self.inside[w] <= budget - self.before[w])
        return int(self.offset[w]) + (int(fits[-1]) + 1 if len(fits) else 0)


class Counter:
    """Counts texts; the prefix counts of words stay from block to block."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.pattern = regex.compile(WORDS)
        self.special = regex.compile("|".join(map(regex.escape, self.vocabulary.special)) or r"(?!)")
        self.known: list[np.ndarray] = []
        self.forget()
        self.table = WordTable(self.learn, self.forget)

    def forget(self) -> None:
        self.totals = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        count, start = self.vocabulary.prefix_counts(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.totals = np.r_[self.totals, count[start + sizes - 1]]

    def split(self, text: str) -> tuple[list[str], int]:
        """Words between special strings, and the number of special strings (a token each)."""
        if not self.vocabulary.special or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.pattern.findall(p)], len(parts) - 1

    def counts(self, texts: list[str]) -> np.ndarray:
        words, sizes, extra = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own, extra[i] = self.split(text)
            sizes[i] = len(own)
            words += own
        running = np.r_[0, np.cumsum(self.totals_of(words))]
        ends = np.cumsum(sizes)
        return running[ends] - running[ends - sizes] + extra

    def totals_of(self, words: list[str]) -> np.ndarray:
        codes = self.table.codes(words)
        return self.totals[codes]

    def counted(self, text: str) -> Counted:
        """All prefix counts of one text. A special string is a token that is there when its last byte is: a cut before that gives
        the tokens of its part as a text by itself."""
        words, special = [], []
        at = 0
        for m in [*self.special.finditer(text), None]:
            part = text[at:m.start()] if m else text[at:]
            own = self.pattern.findall(part)
            words += own
            special += [False] * len(own)
            if m:
                words.append(m.group())
                special.append(True)
                at = m.end()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        count, start = self.vocabulary.prefix_counts(raw)
        inside = [count[s:s + len(w)] for s, w in zip(start.tolist(), raw, strict=True)]
        inside = [np.r_[x[:-1], 1] if own else x for x, own in zip(inside, special, strict=True)]
        before = np.r_[0, np.cumsum([x[-1] for x in inside])].astype(np.int64)
        return Counted(raw, inside, before, np.r_[0, np.cumsum([len(w) for w in raw])].astype(np.int64))


def count_step(path: str, limit: int):
    counter = Counter(path)

    def step(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        tokens = counter.counts(texts)
        sizes = [len(t.encode("utf-8")) for t in texts]
        return [batch.column("doc_id"), sizes, tokens, tokens > limit]

    return step


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of each whole text, and whether it is above the limit.

    ``path``: a vocabulary file that every executor has. A null text counts as an empty one (no bytes, no tokens). Rows that
    repeat give equal rows, and a null doc_id stays null; other columns are not looked at. A very long text is counted whole, in a
    block of its own; an empty table gives no rows.
    """
    return map_blocks(documents.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
                      count_step, path, limit)


def prefix_step(path: str, budgets: tuple[int, ...]):
    counter = Counter(path)

    def step(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = [counter.counted(t) for t in texts]
        return [batch.column("doc_id"), [[c.longest_prefix(b) for b in budgets] for c in found]]

    return step


def truncation_points(documents: DataFrame, path: str, budgets: tuple[int, ...]) -> DataFrame:
    """For each text the bytes of its longest prefix within each token budget, from one pass over the text.

    A null text counts as an empty one; repeated rows give equal rows, an empty table none. Very long texts are counted whole.
    """
    return map_blocks(documents.select("doc_id", "text"), "doc_id long, prefix_bytes array<long>", prefix_step, path, budgets)
