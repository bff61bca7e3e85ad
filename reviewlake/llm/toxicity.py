"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two strings counts their common subsequences of three and of four characters; every character skipped on the way, up to
two between neighbours, costs a factor. Words carry a mark at either end. So a word with letters put in between, or another
ending, still resembles the insult that it is made of.
Insults are words in more toxic sentences than chance explains, given the clean ones. Landmarks (pieces of them) give the Nyström features of a string, and a linear
machine separates them. A sentence is as toxic as its worst word, a text as its worst sentence. Labels belong to texts,
so of the sentences of toxic texts only words that clean sentences lack count as toxic examples; the hardest
words of clean sentences are the examples against.

The machine is linear and the kernel a sum over subsequences, so the margin of a string is a sum of one number for each of its subsequences.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.shared import WordTable, keep, map_blocks

FIRST, LAST = "^", "$"
DECAY = 0.6
GAP = 2
LONGEST = 24
SAMPLE = 2000
"""Labelled texts of each class, about, from which the machine is trained (chosen by a hash of doc_id)."""
CLEAN_TIMES = 4
"""Clean texts for each toxic one of the sample: the more there are, the fewer toxic sentences show that a word is no accident."""
LANDMARKS = 400
HARD = 24
"""Clean words that become landmarks in each round."""
FALSE_SHARE = 0.05
"""Share of the words taken for insults that may be there by chance."""
PIECES = 25
"""Pieces that a word has, about."""
ROUNDS = 2
"""Times that the hardest clean words are sought anew."""
EXAMPLES = 3000
"""Words of either class, at most, that the machine is trained on: of clean texts the hardest ones."""

# Letters one by one with blanks between them are read as one word.
SPELLED = regex.compile(r"(?<!\S)\w(?:[ \t]+\w){2,}(?!\S)")
SENTENCE = regex.compile(r"[.!?\n]+")
NOT_IN_WORD = regex.compile(r"[\W_]+")


def pieces(word: str) -> list[str]:
    """A word without marks, as overlapping windows if it is long; every insult of up to 16 characters lies in one window."""
    word = NOT_IN_WORD.sub("", word)
    if not word:
        return []
    word = f"{FIRST}{word}{LAST}"
    return [word[i:i + LONGEST] for i in range(0, max(1, len(word) - LONGEST + 8), 8)]


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text's sentences, and words that are spelled out letter by letter."""
    if not text:
        return []
    low = text.lower()
    found = low.split()
    for m in SPELLED.finditer(low):
        found.append("".join(m.group().split()))
    return found


class Subsequences:
    """The subsequences of three and of four characters that landmarks have, numbered."""

    def __init__(self, landmarks: list[str]):
        characters = sorted({c for s in landmarks for c in s})
        self.size = len(characters) + 1
        self.number = {ord(c): i + 1 for i, c in enumerate(characters)}
        self.threes = np.full(self.size ** 3, -1, np.int32)
        symbol, owner = self.symbols(landmarks)
        known = np.unique(np.concatenate([self.keys(symbol, at, a, b) for a, b, at in self.steps(symbol, owner)]))
        self.threes[known] = np.arange(len(known))
        self.fours = np.full((len(known), self.size), -1, np.int32)
        self.count = len(known)
        pairs = [(x, symbol[end]) for _, x, end, _ in self.found_fours(symbol, owner, self.found_threes(symbol, owner))]
        x, y = np.unique(np.concatenate([np.stack(q) for q in pairs], axis=1), axis=1) if pairs else np.zeros((2, 0), int)
        self.fours[x, y] = self.count + np.arange(len(x))
        self.count += len(x)

    def symbols(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all characters (0: of no landmark, matches nothing), and the string that each belongs to."""
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
        table = np.zeros(max(int(points.max(initial=0)), max(self.number)) + 1, np.int64)
        table[list(self.number)] = list(self.number.values())
        return table[points], np.repeat(np.arange(len(strings)), sizes)

    def steps(self, symbol: np.ndarray, owner: np.ndarray):
        """For each pair of distances the places where three known characters begin."""
        for a in range(1, GAP + 2):
            for b in range(1, GAP + 2):
                n = len(symbol) - a - b
                if n > 0:
                    yield a, b, np.flatnonzero((symbol[:n] > 0) & (symbol[a:a + n] > 0) & (symbol[a + b:] > 0)
                                               & (owner[:n] == owner[a + b:]))

    def keys(self, symbol: np.ndarray, at: np.ndarray, a: int, b: int) -> np.ndarray:
        return (symbol[at] * self.size + symbol[at + a]) * self.size + symbol[at + a + b]

    def found_threes(self, symbol: np.ndarray, owner: np.ndarray) -> list[tuple]:
        """(owner, number, place of the last character, skipped characters) of the landmarks' subsequences of three."""
        out = []
        for a, b, at in self.steps(symbol, owner):
            number = self.threes[self.keys(symbol, at, a, b)]
            hit = number >= 0
            out.append((owner[at[hit]], number[hit], at[hit] + a + b, a + b - 2))
        return out

    def found_fours(self, symbol: np.ndarray, owner: np.ndarray, threes: list[tuple]):
        """The same with a further character: owner, number of the three, place of the last one, skipped characters."""
        for own, number, end, skipped in threes:
            for c in range(1, GAP + 2):
                last = np.minimum(end + c, len(symbol) - 1)
                good = (end + c < len(symbol)) & (owner[last] == own) & (symbol[last] > 0)
                yield own[good], number[good], last[good], skipped + c - 1

    def of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, number and weight of every subsequence that landmarks have."""
        symbol, owner = self.symbols(strings)
        threes = self.found_threes(symbol, owner)
        out = [(own, number, np.full(len(own), DECAY ** skipped)) for own, number, _, skipped in threes]
        for own, number, end, skipped in self.found_fours(symbol, owner, threes):
            four = self.fours[number, symbol[end]]
            hit = four >= 0
            out.append((own[hit], four[hit], np.full(int(hit.sum()), DECAY ** skipped)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Machine:
    """Margin of a string: ``bias`` plus a number for each of its subsequences. Probability: a sigmoid of a text's margin."""

    subsequences: Subsequences
    value: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, strings: list[str]) -> np.ndarray:
        owner, key, weight = self.subsequences.of(strings)
        return self.bias + np.bincount(owner, weight * self.value[key], minlength=len(strings))

    def word_margins(self, words: list[str]) -> np.ndarray:
        """A word's largest margin over its windows."""
        cut = [pieces(w) or [""] for w in words]
        flat = self.margins([p for c in cut for p in c])
        return np.maximum.reduceat(flat, np.cumsum([0] + [len(c) for c in cut[:-1]])) if words else np.zeros(0)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def chance(toxic: int, clean: int, p: float) -> float:
    """Probability that of ``toxic + clean`` sentences at least ``toxic`` are toxic ones, if each is with probability ``p``."""
    n = toxic + clean
    if not 0 < p < 1:
        return 1.0
    ways = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p) for k in range(toxic, n + 1)]
    top = max(ways)
    return min(1.0, exp(top) * sum(exp(w - top) for w in ways))


class Tested:
    """How many words would by chance alone look as toxic as one that is in so many toxic and clean sentences."""

    def __init__(self, words_by_sentences: dict[int, int], p: float):
        self.p, self.sizes = p, sorted(words_by_sentences)
        counts = np.array([words_by_sentences[n] for n in self.sizes], np.int64)
        self.at_least = np.cumsum(counts[::-1])[::-1]

    def expected(self, toxic: int, clean: int) -> float:
        """A word in fewer sentences cannot look as toxic, so only those in at least as many are tried."""
        at = bisect_left(self.sizes, toxic + clean)
        tried = int(self.at_least[at]) if at < len(self.sizes) else 1
        return max(1, tried) * chance(toxic, clean, self.p)


def choose_insults(toxic: Counter, clean: dict[str, int], tested: Tested) -> list[str]:
    """Words of which at most ``FALSE_SHARE`` are expected to be accidents; if there are none, the least accidental ones."""
    memo: dict[tuple, float] = {}
    found = []
    for w, n in toxic.items():
        key = (n, clean.get(w, 0))
        if key not in memo:
            memo[key] = tested.expected(*key)
        found.append((memo[key], w))
    found.sort()
    many = max((i for i, (e, _) in enumerate(found, 1) if e <= FALSE_SHARE * i), default=0)
    return [w for _, w in found[:many]] if many else [w for e, w in found if e == found[0][0]]


def choose_landmarks(toxic: Counter, clean: Counter, least: float, many: int = LANDMARKS) -> list[str]:
    """Pieces of four to eight characters that cover most toxic occurrences and least clean ones, chosen one after the other."""
    left, chosen = dict(toxic), []
    in_clean: Counter = Counter()
    spans = lambda w: {w[i:i + n] for n in range(4, 9) for i in range(len(w) - n + 1)}
    for w, n in clean.items():
        for s in spans(w):
            in_clean[s] += n
    gain: Counter = Counter()
    for w, n in left.items():
        for s in spans(w):
            gain[s] += n
    while left and len(chosen) < many:
        best = max(gain, key=lambda s: (gain[s] - 5 * in_clean[s], len(s), s), default=None)
        if best is None or gain[best] - 5 * in_clean[best] < least:
            break
        chosen.append(best)
        for w in [w for w in left if best in w]:
            n = left.pop(w)
            for s in spans(w):
                gain[s] -= n
    return chosen


def with_gaps(words: list[str], seed: int = 7) -> list[str]:
    """The words with one letter put in at a random place, as examples of disguise."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for w in words:
        at = int(rng.integers(2, max(3, len(w) - 1)))
        out.append(w[:at] + letters[int(rng.integers(26))] + w[at:])
    return out


def separate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, both classes of equal weight (accelerated gradient)."""
    share = weight * np.where(y > 0, 0.5 / weight[y > 0].sum(), 0.5 / weight[y < 0].sum())
    z = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], 1.0), 1e-3]
    rate = 1 / (1 + 2 * cost * np.linalg.norm(z * np.sqrt(share)[:, None], 2) ** 2)
    w = ahead = np.zeros(z.shape[1])
    for i in range(steps):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        step = ahead - rate * (ridge * ahead - 2 * cost * z.T @ (share * slack * y))
        ahead, w = step + i / (i + 3) * (step - w), step
    return w[:-1], float(w[-1])


def train_machine(toxic: list[str], clean: list[str], landmarks: list[str]) -> Machine:
    """Nyström features of example words against the landmarks, and the linear machine on them.

    Toxic words with the same (first) landmark share one weight: endings of one stem do not outweigh another insult.
    """
    stems = [next((s for s in landmarks if s in w), w) for w in toxic]
    sizes = Counter(stems)
    subsequences = Subsequences(landmarks)
    owner, key, weight = subsequences.of(landmarks)
    mine = np.zeros((len(landmarks), subsequences.count))
    np.add.at(mine, (owner, key), weight)
    gram = mine @ mine.T
    value, vector = np.linalg.eigh(gram)
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    words = [*toxic, *with_gaps(toxic), *clean]
    y = np.r_[np.ones(2 * len(toxic)), -np.ones(len(clean))]
    kernel = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 100):
        owner, key, weight = subsequences.of(words[at:at + 100])
        np.add.at(kernel, at + owner, weight[:, None] * mine[:, key].T)
    features = kernel @ root
    scale = np.maximum(features.std(axis=0), 1e-6)
    weight = np.r_[np.tile([1 / sizes[s] for s in stems], 2), np.ones(len(clean))]
    w, bias = separate(features / scale, y, weight, 10.0 * max(1.0, len(sizes) / 5))
    return Machine(subsequences, mine.T @ (root @ (w / scale)), bias)


def word_step():
    def step(batch: pa.RecordBatch):
        words, sentences, toxic = [], [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for sentence in set(SENTENCE.split(text)):
                own = {p for w in words_of(sentence) for p in pieces(w)}
                words += own
                sentences += [hashlib.blake2b(sentence.encode("utf-8", "surrogatepass"), digest_size=8).digest()] * len(own)
                toxic += [label] * len(own)
        return [words, sentences, toxic]

    return step


def margin_step(machine: Machine, columns: tuple[str, ...]):
    state = {"margin": np.zeros(0)}

    def learn(words):
        state["margin"] = np.r_[state["margin"], machine.word_margins(words)]

    table = WordTable(learn, lambda: state.update(margin=np.zeros(0)))

    def step(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        words, ends = [], []
        for t in texts:
            words += words_of(t)
            ends.append(len(words))
        codes = table.codes(words)
        # Words that are not there are as clean as a string without any subsequence.
        out = np.full(len(texts), machine.bias)
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        has = np.flatnonzero(np.asarray(ends) > starts)
        if len(has):
            out[has] = np.maximum.reduceat(state["margin"][codes], starts[has])
        return [*[batch.column(c) for c in columns], out]

    return step


def text_margins(texts: DataFrame, machine: Machine, columns: str) -> DataFrame:
    names = tuple(part.split()[0] for part in columns.split(", "))
    return map_blocks(texts.select(*dict.fromkeys((*names, "text"))), f"{columns}, margin double", margin_step, machine,
                      names)


def hardest_step(machine: Machine):
    def step(batch: pa.RecordBatch):
        words = batch.column("word").to_pylist()
        return [words, machine.margins(words)]

    return step


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """Train on a sample of labelled texts; None if a class is missing, or no word is in more than its share of toxic texts.

    ``labels``: ``doc_id, toxic``; rows with nulls are passed over, and of contradicting rows the toxic one counts.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marked.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    shares = {0: min(1.0, CLEAN_TIMES * sample / counts[0]), 1: min(1.0, sample / counts[1])}
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    chosen = marked.filter("toxic in (0, 1)").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # About 5 x `sample` rows of two numbers, so they may be sent to every task.
    texts = keep(documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id"))
    # A sentence counts once, however many copies of it there are: what copied toxic texts happen to say is not toxic.
    words = map_blocks(texts.select("text", "toxic"), "word string, sentence binary, toxic int", word_step).distinct()
    seen = keep(words.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("n_toxic"),
                                          F.count_if(F.col("toxic") == 0).alias("n_clean")))
    ratio = max(1.0, counts[0] / counts[1]) * shares[0] / shares[1]
    suspect = (F.col("n_toxic") >= 1) & (F.col("n_toxic") > 10 * F.col("n_clean") / F.lit(max(ratio, 1e-9)))
    sums = {r.n: r for r in seen.groupBy((F.col("n_toxic") + F.col("n_clean")).alias("n"))
            .agg(F.count("*").alias("words"), F.sum("n_toxic").alias("n_toxic")).collect()}
    pairs = sum(n * r.words for n, r in sums.items())
    tested = Tested({n: r.words for n, r in sums.items()}, sum(r.n_toxic for r in sums.values()) / max(1, pairs))
    toxic_rows = seen.filter(suspect).orderBy(F.desc("n_toxic"), "word").limit(EXAMPLES).collect()
    common = seen.filter("n_clean > 0").orderBy(F.desc("n_clean"), "word").limit(5 * EXAMPLES).collect()
    toxic = Counter({r.word: r.n_toxic for r in toxic_rows})
    if not toxic:
        return None
    clean = Counter({r.word: r.n_clean for r in common})
    insults = choose_insults(toxic, {r.word: r.n_clean for r in toxic_rows}, tested)
    # Pieces of the insults; and pieces that are no accident taken together, though each word with them may be.
    own = choose_landmarks(Counter({w: toxic[w] for w in insults}), clean, 1)
    enough = max(2.0, log(FALSE_SHARE / PIECES) / log(min(max(tested.p, 1e-9), 0.99)))
    offered = list(dict.fromkeys([*own, *choose_landmarks(toxic, clean, enough, len(own) + 48)]))
    # The choice saw the most frequent clean words; now all of them count.
    totals = seen.agg(*[F.sum(F.when(F.col("word").contains(s), F.col(n)).otherwise(0)).alias(f"{n}_{i}")
                        for i, s in enumerate(offered) for n in ("n_toxic", "n_clean")]).first() if offered else {}
    landmarks = []
    for i, s in enumerate(offered):
        n, m = totals[f"n_toxic_{i}"], totals[f"n_clean_{i}"]
        if n * ratio > 20 * m and (s in own or PIECES * tested.expected(n, m) <= FALSE_SHARE):
            landmarks.append(s)
    # An insult whose pieces clean words share is a landmark itself.
    landmarks += [w for w in insults if not any(s in w for s in landmarks)]
    landmarks = landmarks[:LANDMARKS]
    positive = [w for w in toxic if any(s in w for s in landmarks)]
    machine = train_machine(positive, list(clean)[:EXAMPLES], landmarks)
    # Again with the clean words that the machine finds hardest; the worst of them are landmarks too.
    held = seen.filter("n_clean > 0 and n_clean >= n_toxic").select("word")
    hard: dict[str, None] = {}
    for _ in range(ROUNDS):
        found = (map_blocks(held, "word string, margin double", hardest_step, machine, text="word")
                 .orderBy(F.desc("margin"), "word").limit(EXAMPLES).collect())
        hard |= dict.fromkeys(r.word for r in found)
        landmarks += [r.word for r in found if r.word not in landmarks][:HARD]
        machine = train_machine(positive, [*hard, *list(clean)[:EXAMPLES // 2]], landmarks)
    pairs = text_margins(texts, machine, "doc_id long, toxic int").select("toxic", "margin").collect()
    machine.slope, machine.shift = calibrate(np.array([r.margin for r in pairs]), np.array([r.toxic for r in pairs]))
    return machine


def calibrate(margin: np.ndarray, toxic: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a sigmoid with smoothed targets, by Newton's method, both classes of equal weight."""
    n1, n0 = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.where(toxic == 1, 0.5 / n1, 0.5 / n0)
    z, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        gradient = z.T @ (share * (p - target)) + 1e-6 * w
        curve = (z * (share * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def score_texts(texts: DataFrame, machine: Machine | None, columns: str = "doc_id long") -> DataFrame:
    """``columns`` of each row with ``score`` (0 to 1) and ``predicted`` (1 from 0.5) for its whole text.

    Null and empty texts have the score of a text without any suspicious word. Without a machine all scores are 0. Repeated
    rows give equal rows; a null doc_id stays null. Very long texts are scored whole; an empty table gives no rows.
    """
    names = [part.split()[0] for part in columns.split(", ")]
    if machine is None:
        return texts.select(*names, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    z = F.lit(machine.slope) * F.col("margin") + F.lit(machine.shift)
    score = F.round(1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))), 9)
    return (text_margins(texts, machine, columns).withColumn("score", score)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("margin"))


def held_out():
    """Rows that are kept out of training, by the checksum of doc_id; a null doc_id is held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def toxicity_of_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's toxicity, learned from the labelled documents that are not held out; see ``score_texts`` for unusual rows."""
    machine = fit(documents.filter(~held_out()), labels.filter(~held_out()))
    return score_texts(documents, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
