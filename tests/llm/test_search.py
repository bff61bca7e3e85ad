"""Lexical search, spelling variants and packing against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewlake.llm import lexical, packing, variants

WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---- lexical search ------------------------------------------------------------

def plain_terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_ranks(docs, items, k=10):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc, c, n in counted:
            m = 25 + 75 * n * n_docs // total
            score = sum(often * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t, often in Counter(plain_terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item_id, r, doc, -score) for r, (score, _, doc) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return out


def test_terms_of_odd_texts():
    rng = random.Random(5)
    letters = "aZ09 _-\n\x00\x7fÀéßİ日\U0001f600\xa0\x85{`[@/:"
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text)


def test_ranks_of_the_given_tables(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_ranks([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = [tuple(r) for r in lexical.rank_documents(documents, items).collect()]
    assert sorted(got) == sorted(want)


def test_ranks_of_odd_documents(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "one two lazy QUICK quick"), (2, None), (3, ""), (4, "!!"), (5, "nowhere"), (1, "words é 日本"),
                                   (None, "dog")], "item_id long, text string").selectExpr("*", "'x' as rank", "1 as score")
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    want = plain_ranks(docs, [(r.item_id, r.text) for r in items.collect()])
    got = [tuple(r) for r in lexical.rank_documents(odd_documents, items).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lexical.rank_documents(no_documents, items).collect() == []
    assert lexical.rank_documents(odd_documents, items.limit(0)).collect() == []


def test_portions_of_items_change_nothing(spark, sf, documents, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(tuple(r) for r in lexical.rank_documents(documents, items).collect())
    monkeypatch.setattr(lexical, "ITEM_BYTES", 4000)
    assert sorted(tuple(r) for r in lexical.rank_documents(documents, items).collect()) == want


def test_tree_prunes_and_misses_nothing():
    rng = np.random.default_rng(4)
    n_terms, rows = 60, 3000
    sizes = rng.integers(1, 12, rows)
    terms = np.concatenate([rng.choice(n_terms, s, replace=False) for s in sizes])
    values = rng.integers(0, 5, sizes.sum()) * 100_000
    weights = rng.integers(0, 9000, n_terms)
    asked = [rng.choice(n_terms, 6, replace=False).tolist() for _ in range(20)]
    items = lexical.Items(asked, [[1] * 6] * 20, weights)
    search = lexical.Search(items, 10)
    ids = rng.permutation(rows)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, rows, 1000):
        search.block(ids[a:a + 1000], np.zeros(1000, bool), sizes[a:a + 1000], terms[edges[a]:edges[a + 1000]],
                     values[edges[a]:edges[a + 1000]])
    owner = np.repeat(np.arange(rows), sizes)
    for i, own in enumerate(asked):
        score = np.bincount(owner, np.where(np.isin(terms, own), values * weights[terms], 0), rows).astype(np.int64)
        best = np.lexsort((ids, -score))[:10]
        best = best[score[best] > 0]
        assert search.best[i][0].tolist() == score[best].tolist() and search.best[i][1].tolist() == ids[best].tolist()
    assert search.scored < 0.8 * search.seen


# ---- spelling variants ------------------------------------------------------------

def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(docs):
    words = Counter()
    for doc, text in docs:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                words[run] += 1
    words = {w: n for w, n in words.items() if n >= 5}
    shorter = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1:]].add(w)
    near = {w: {v for i in range(len(w)) for v in shorter[w[:i] + w[i + 1:]] | ({w[:i] + w[i + 1:]} & words.keys())}
            | shorter[w] for w in words}
    near = {w: {v for v in found if one_apart(w, v)} for w, found in near.items()}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, form[w], root, len(near[w]), words.get(form[w])))
    return out


def test_scan_equals_comparing_all_pairs():
    rng = random.Random(2)
    for _ in range(40):
        half = rng.choice([1, 2, 3])
        words, group = [], []
        for g in range(rng.randrange(1, 5)):
            key = "".join(rng.choice("ab") for _ in range(half))
            own = sorted({key + "".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(40)})
            words, group = words + own, group + [g] * len(own)
        found = variants.SortedList(words, np.array(group), np.full(len(words), half))
        got = [(int(q), int(r)) for a, b in found.near(np.arange(len(words))) for q, r in zip(a, b, strict=True)]
        assert sorted(got) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words)
                               if group[i] == group[j] and one_apart(a, b)]


def test_variants_of_the_given_documents(documents):
    want = plain_variants([(r.doc_id, r.text) for r in documents.collect()])
    got = [tuple(r) for r in variants.spelling_variants(documents).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)


@pytest.mark.parametrize("portion", [3, 2048])
def test_lists_in_portions(spark, monkeypatch, portion):
    monkeypatch.setattr(variants, "PORTION", portion)
    rng = random.Random(8)
    words = {"same" + "".join(rng.choice("ab") for _ in range(rng.randrange(2, 7))) for _ in range(150)}
    words |= {w[::-1] for w in words} | {"a", "", "b", "ab", "ba", "日本語", "日本", "日語"}
    frame = spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n long")
    got = [tuple(r) for r in variants.near_words(frame).collect()]
    assert sorted(got) == sorted((a, b, len(b)) for a in words for b in words
                                 if one_apart(a, b) and min(len(a), len(b)) > 1)


def test_forms_of_forms(spark):
    """A chain of forms ends in one root, whatever its length; equal counts go to the smaller word."""
    chain = ["aaaaaa" + "b" * i for i in range(12)]
    rows = [(w, 5 ** (i + 1)) for i, w in enumerate(chain)] + [("zzzzza", 50), ("zzzzzb", 50), ("zzzzzz", 10)]
    words = spark.createDataFrame(rows, "word string, n long")
    got = {r.word: r for r in variants.with_forms(words, variants.near_words(words)).collect()}
    assert all(got[w].root == chain[-1] for w in chain) and got[chain[0]].form == chain[1]
    assert (got["zzzzzz"].form, got["zzzzzz"].n_near, got["zzzzza"].form) == ("zzzzza", 2, None)


def test_variants_of_odd_documents(spark, odd_documents, no_documents):
    docs = odd_documents.unionByName(spark.createDataFrame(
        [(None, "separate seperate Separate SEPARATE " * 9), (77, "ÀÈÌÒÙÝ àèìòùý ÀÈÌÒÙý " * 30), (77, "y" * 70_000 + " " + "y" * 70_001)],
        "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.unionByName(docs).unionByName(docs)
    docs = docs.unionByName(docs)
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    got = [tuple(r) for r in variants.spelling_variants(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and max(len(w[0]) for w in got) == 70_001
    assert variants.spelling_variants(no_documents).collect() == []


# ---- packing ------------------------------------------------------------

def plain_packing(lengths, limit):
    """One sequence after the other, one piece at a time."""
    left, out = Counter(lengths), []
    while left:
        used, gap = [], limit
        while True:
            fit = max((n for n in left if n <= gap), default=None)
            if fit is None:
                break
            used.append(fit)
            gap -= fit
            left -= Counter([fit])
        pairs = [(a + b, a, b) for a in left for b in left if a >= b and (a != b or left[a] > 1)
                 and min(used) < a + b <= gap + min(used)]
        if gap and pairs:
            _, a, b = max(pairs)
            least = min(used)
            used.remove(least)
            used += [a, b]
            left = left - Counter([a, b]) + Counter([least])
        out.append(tuple(sorted(used, reverse=True)))
    return out


def test_fillings_equal_one_piece_at_a_time():
    rng = random.Random(6)
    for _ in range(60):
        limit = rng.choice([10, 50, 100])
        lengths = [rng.randrange(1, limit + 1) for _ in range(rng.randrange(1, 120))]
        got = [tuple(n for n, each in parts for _ in range(each))
               for times, parts in packing.fillings(dict(Counter(lengths)), limit) for _ in range(times)]
        assert sorted(got) == sorted(plain_packing(lengths, limit))
    with pytest.raises(ValueError):
        packing.fillings({0: 1}, 10)


def test_two_pieces_replace_the_shortest():
    # 60 + 30 leaves 10; with the 30 out, 25 + 15 fill the gap of 40 whole.
    assert packing.fillings({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == (1, [(60, 1), (25, 1), (15, 1)])


def test_ids_equal_the_library():
    rng = random.Random(1)
    letters = ["a", "b", " ", "  ", "\n", "é", "É", "ing", "the", " the", "1", "23", "!", "'s", "'S", "日本", "。", "\U0001f600", "\t",
               "<|endoftext|>", "<|startoftext|>", "\0", "ß", "́", "\r\n", "İ", "Σ", ".", ",", "\xa0", "\x1c", "\x85", "क़", "़",
               "　", "_", "²"]
    texts = ["", " "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    texts += ["日本語。漢字、" * 3000, "x" * 5000, "word. " * 3]
    ids, counts = packing.Encoder(WORDS).block([t.encode() for t in texts])
    want = [e.ids + [1] for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in np.split(ids, np.cumsum(counts)[:-1])] == want
    long = "one two, three\n" * 300
    parts = list(packing.slices(long.encode(), 50))
    assert b"".join(parts) == long.encode() and len(parts) > 20


def check_packing(docs, rows, limit):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), limit)):
            own = ids[start:start + limit]
            want[r.doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit
    return len(inside), sum(r.length for r in rows)


def test_packing_of_the_given_documents(documents):
    n, total = check_packing(documents, packing.pack_documents(documents, WORDS).collect(), 4096)
    assert n <= -(-total // 4096) + 1


@pytest.mark.parametrize("limit", [1, 7, 4096])
def test_packing_of_odd_documents(odd_documents, no_documents, limit, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 20_000)
    packed = packing.pack_documents(odd_documents, WORDS, limit=limit, with_ids=True)
    check_packing(odd_documents, packed.collect(), limit)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= limit
    assert packing.pack_documents(no_documents, WORDS).collect() == []
