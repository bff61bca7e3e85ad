"""Token counts, SentencePiece and fingerprints against the libraries and plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewlake.llm import fingerprints, pieces, token_counts

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["a", "b", " ", "  ", "\n", "é", "ing", "the", " the", "▁", "1", "23", "!", "'s", "日", "\U0001f600", "\t", "aaaa",
           "<s>", "</s>", "<|endoftext|>", "\u0000", "ß", "́", "\r\n", "tion"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["", " ", "   ", "a" * 3000, " " * 700, "▁" * 33] + [
        "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]


def test_counts_equal_the_library(texts):
    library = Tokenizer.from_file(BPE)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(BPE).counts(texts).tolist() == want


def test_every_prefix_of_a_word_is_exact():
    library, counter = Tokenizer.from_file(BPE), token_counts.Counter(BPE)
    for word in ["internationalization", "thntionstheredly", "aaaaaaaaaaab", "x1y2"]:
        found = counter.counted(word)
        if len(found.words) == 1:
            assert found.inside[0].tolist() == [len(library.encode(word[:i + 1]).ids) for i in range(len(word))]


def test_budgets_are_answered_without_encoding_again():
    counter, text = token_counts.Counter(BPE), "The quick brown fox jumps over the lazy dog, again and again."
    found = counter.counted(text)
    assert found.total() == counter.counts([text])[0]
    for budget in range(found.total() + 2):
        cut = text.encode()[:found.longest_prefix(budget)].decode()
        assert counter.counts([cut])[0] <= budget
    assert found.longest_prefix(found.total()) == len(text.encode())


def test_prefix_counts_with_special_strings():
    """Totals and cuts agree with the library where a special string is one token."""
    counter, library = token_counts.Counter(BPE), Tokenizer.from_file(BPE)
    special = next(iter(counter.vocabulary.special))
    for text in (special, f"one two{special}three four", f"{special}{special} x", f"end {special}"):
        found = counter.counted(text)
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert found.total() == counter.counts([text])[0] == want
        assert found.longest_prefix(want) == len(text.encode())
    assert counter.counted(special + " word").longest_prefix(1) == len(special.encode())


def test_truncation_points(spark, odd_documents, no_documents):
    rows = token_counts.truncation_points(odd_documents, BPE, (0, 3, 10**6)).collect()
    assert len(rows) == odd_documents.count() and all(r.prefix_bytes[0] == 0 for r in rows)
    assert token_counts.truncation_points(no_documents, BPE, (3,)).collect() == []


def test_counts_of_odd_documents(odd_documents, no_documents):
    library = Tokenizer.from_file(BPE)
    rows = token_counts.count_tokens(odd_documents, BPE).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
            for r in odd_documents.collect()]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.count_tokens(no_documents, BPE).collect() == []


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_ids_and_texts_equal_the_library(texts, library):
    encoder = pieces.Encoder(PIECE)
    ids, ends = encoder.encode(texts)
    got = [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert got == [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [t.decode() for t in encoder.model.decode(ids, ends)] == [library.decode(x) for x in got]


def test_any_ids_decode_as_in_the_library(library):
    rng, model = random.Random(9), pieces.piece_model(PIECE)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2, 28705]) for _ in range(rng.randrange(12))]
        got = model.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].decode()
        assert got == library.decode(ids), ids


def test_digests_of_odd_documents(odd_documents, no_documents, library):
    rows = pieces.token_digests(odd_documents, PIECE, with_ids=True).collect()
    want = []
    for r in odd_documents.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == Counter(want)
    assert pieces.token_digests(no_documents, PIECE).collect() == []


def test_encode_and_decode_are_a_round_trip(odd_documents):
    plain = odd_documents.filter("doc_id > 1 and doc_id <> 8")
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(plain, PIECE), PIECE).collect()}
    assert back == {r.doc_id: r.text or "" for r in plain.collect()}


def weighted_likeness(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_estimate_the_likeness():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    sampler, errors = fingerprints.Sampler(256), []
    for _ in range(150):
        a = " ".join(rng.choice(words[:40]) for _ in range(80))
        b = " ".join(rng.choice(words[20:] if rng.random() < 0.3 else words[:40]) for _ in range(80))
        x, y = sampler.fingerprints([a, b])
        errors.append((x == y).mean() - weighted_likeness(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def plain_edits(rows):
    """By doc_id with ties: edited text of each row; a null id counts as the least."""
    least = -(1 << 63)
    ids = sorted({least if r.doc_id is None else r.doc_id for r in rows})
    return {i: ids[(n + 1) % len(ids)] for n, i in enumerate(ids)}


def test_edits_of_documents(documents, no_documents):
    rows = {r.doc_id: r for r in fingerprints.fingerprints_and_edits(documents).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    order = sorted(texts)
    assert sorted(rows) == order
    sampler = fingerprints.Sampler()
    for n, i in enumerate(order):
        t, after = texts[i], texts[order[(n + 1) % len(order)]]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        a, b, c = sampler.fingerprints([t, edited, after])
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == a.astype(">u4").tobytes().hex() and r.edited_fingerprint == b.astype(">u4").tobytes().hex()
        assert (r.near_edited, r.near_next) == ((a == b).mean(), (a == c).mean())
    assert fingerprints.fingerprints_and_edits(no_documents).collect() == []


def test_edits_of_odd_documents(odd_documents):
    source = odd_documents.collect()
    following = plain_edits(source)
    texts = {}
    for r in source:
        texts.setdefault(-(1 << 63) if r.doc_id is None else r.doc_id, set()).add(r.text or "")
    rows = fingerprints.fingerprints_and_edits(odd_documents).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in source)
    for r in rows:
        key = -(1 << 63) if r.doc_id is None else r.doc_id
        allowed = {hashlib.sha256((t[:len(t) - len(t) // 4] + n[:len(t) // 4]).encode()).hexdigest()
                   for t in texts[key] for n in texts[following[key]]}
        assert r.edited_sha256 in allowed
    single = fingerprints.fingerprints_and_edits(odd_documents.filter("doc_id = 7")).collect()[0]
    assert single.near_next == 1.0
    assert fingerprints.fingerprint(odd_documents).count() == len(source)
