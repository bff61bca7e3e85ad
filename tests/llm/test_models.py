"""Language and toxicity: held-out accuracy, plain versions of the arithmetic, odd input; the pipeline against a plain one."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlake.llm import catalog, language, pieces, toxicity
from tests.llm.test_links import plain_components


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = catalog.op8_language_id(spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_language_is_learned(spark):
    table = spark.range(1010).selectExpr("id doc_id", "concat('text', id) text", "concat('lang', id) lang")
    assert len(language.fit(table, width=64).languages) == 1010


def plain_profile(text, width=language.WIDTH):
    """The bundle of one text, letter by letter."""
    letters = [c if c.isalpha() else "\n" for c in text.lower()]
    stream = "\n" + "".join(c for i, c in enumerate(letters) if c != "\n" or (i and letters[i - 1] != "\n")).strip("\n") + "\n"
    vector = {c: language.letter_vectors(np.array([0 if c == "\n" else ord(c)]), width)[0].astype(int) for c in set(stream)}
    grams = [stream[i:i + 3] for i in range(len(stream) - 2)]
    return sum((np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c] for a, b, c in grams), np.zeros(width))


@pytest.mark.parametrize("text", ["Hello, wörld! a", "x", "  two  words\n", "ÀÉ--ß 12 zz"])
def test_profiles_equal_a_plain_bundle(text):
    block = language.grams_of(["other", text, None, ""], language.WIDTH)
    assert np.array_equal(block.profiles(1, 2)[0], plain_profile(text))
    assert block.has_letter.tolist() == [True, True, False, False]
    assert not block.profiles(2, 4).any()


def test_language_of_odd_documents(odd_documents, no_documents):
    rows = language.language_of_documents(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (2, 3, 6, 9))
    assert {r.lang_pred for r in rows} <= {"und", "en", "fr", "de"} and by_id[None].held_out
    assert language.language_of_documents(no_documents).collect() == []
    unlabelled = language.language_of_documents(odd_documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def plain_kernel(a, b):
    """Common subsequences of three and of four characters with up to GAP skipped between neighbours."""
    def found(s):
        out = Counter()

        def go(at, text, skipped):
            if len(text) >= 3:
                out[text] += toxicity.DECAY ** skipped
            if len(text) < 4:
                for j in range(at + 1, min(len(s), at + toxicity.GAP + 2)):
                    go(j, text + s[j], skipped + j - at - 1)

        for i in range(len(s)):
            go(i, s[i], 0)
        return out

    x, y = found(a), found(b)
    return sum(x[k] * y[k] for k in x)


def test_features_equal_the_plain_kernel():
    marks, words = ["^idiot$", "^veju", "scum"], ["^idiot$", "^idxiot$", "^vejuaire$", "^plain$", "^s.c.u.m$", "ab", ""]
    subsequences = toxicity.Subsequences(marks)
    mine = np.zeros((3, subsequences.count))
    owner, key, weight = subsequences.of(marks)
    np.add.at(mine, (owner, key), weight)
    owner, key, weight = subsequences.of(words)
    got = np.zeros((len(words), 3))
    np.add.at(got, owner, weight[:, None] * mine[:, key].T)
    assert np.allclose(got, [[plain_kernel(w, m) for m in marks] for w in words])


def test_margin_is_the_machine_on_the_features():
    machine = toxicity.train_machine(["^idiot$", "^moron$"], ["^plain$", "^notion$", "^riot$", "^morning$"], ["^idiot$", "^moron$"])
    margins = machine.margins(["^idiot$", "^idxiot$", "^moron$", "^plain$", "^notion$", "^morning$"])
    assert (margins[:3] > 0).all() and (margins[3:] < 0).all()


def insults(spark, n=900):
    """Clean sentences, and some with an insult; half of the later ones in disguise."""
    rng = np.random.default_rng(8)
    plain = ["house", "garden", "river", "morning", "notion", "walks", "under", "yellow", "patient", "stone", "clock", "riot"]
    bad = ["idiot", "moron", "scumbag", "wretched"]
    disguise = [lambda w: w, lambda w: w[:3] + "x" + w[3:], lambda w: " ".join(w), lambda w: "*".join(w), str.upper]
    rows, labels = [], []
    for i in range(n):
        words = [plain[k] + str(rng.integers(9)) * int(rng.integers(2)) for k in rng.integers(0, len(plain), 30)]
        toxic = int(i % 4 == 0)
        if toxic:
            how = disguise[0] if zlib.crc32(str(i).encode()) % 5 else disguise[int(rng.integers(len(disguise)))]
            words[int(rng.integers(30))] = how(bad[int(rng.integers(len(bad)))])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_documents_and_disguises(spark):
    documents, labels = insults(spark)
    rows = toxicity.toxicity_of_documents(documents, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 100
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.9
    assert np.mean([r.predicted for r in held if not r.toxic]) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    documents, labels = insults(spark, 200)
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1), (4, None), (5, 1), (5, 0)], "doc_id long, toxic int"))
    machine = toxicity.fit(documents, odd_labels)
    rows = toxicity.score_texts(odd_documents, machine).collect()
    assert len(rows) == odd_documents.count()
    empty = {r.score for r in rows if r.doc_id in (2, 3, 6)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert toxicity.toxicity_of_documents(no_documents, labels).collect() == []
    alone = toxicity.toxicity_of_documents(odd_documents, labels.filter("toxic = 0")).collect()
    assert {r.score for r in alone} == {0.0} and len(alone) == odd_documents.count()


def test_rare_insults_are_learned(spark):
    """Six toxic sentences among hundreds of clean ones are no accident; two are the best there is where nothing else is found."""
    plain = ["house", "garden", "river", "walks", "under", "yellow", "patient", "stone", "clock", "riot"]
    rng = np.random.default_rng(3)
    for bad, each in ((["scumbag", "wretched"], 6), (["scumbag"], 2)):
        rows = []
        for i in range(400):
            words = [plain[k] + str(rng.integers(9)) for k in rng.integers(0, len(plain), 12)]
            toxic = int(i < each * len(bad))
            rows.append((i, " ".join(words[:5] + [bad[i % len(bad)]] * toxic + words[5:]) + ".", toxic))
        table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        machine = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
        texts = [*bad, *(f"under {w} river1" for w in bad), *(" ".join(w) for w in bad), "house garden river1 stone2"]
        asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = [r.predicted for r in toxicity.score_texts(asked, machine).orderBy("doc_id").collect()]
        assert got == [1] * 3 * len(bad) + [0]


def test_chance_is_a_binomial_tail():
    assert toxicity.chance(5, 0, 0.2) == pytest.approx(0.2 ** 5)
    assert toxicity.chance(1, 1, 0.5) == pytest.approx(0.75)
    tested = toxicity.Tested({1: 100, 5: 10, 7: 2}, 0.2)
    assert tested.expected(5, 0) == pytest.approx(12 * 0.2 ** 5) and tested.expected(9, 0) == pytest.approx(0.2 ** 9)


def test_pipeline_against_a_plain_one(spark, sf):
    """Each stage on what the one before it kept, with plain versions of what is not a trained model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, sf)
        if name != "sentencepiece":
            assert out.columns[:5] == corpus_pipeline.COLUMNS
        after = out.collect()
        ids = [r.doc_id for r in after]
        if name == "language_id":
            prototypes = language.fit(docs.filter(~language.held_out()))
            profiles = np.array([plain_profile(r.text) for r in before])
            _, cosine = prototypes.classify(profiles)
            assert set(ids) == {r.doc_id for r, c in zip(before, cosine, strict=True)
                                if any(x.isalpha() for x in r.text) and c >= corpus_pipeline.LEAST_COSINE}
        if name == "toxicity":
            machine = toxicity.fit(docs.filter(~toxicity.held_out()),
                                   spark.read.parquet(f"{sf}/labels.parquet").filter(~toxicity.held_out()))
            worst = {r.doc_id: max([machine.bias, *machine.word_margins(toxicity.words_of(r.text))]) for r in before}
            assert set(ids) == {i for i, m in worst.items() if machine.probability(np.array([m]))[0] < 0.5}
        if name == "jaccard_join":
            assert Counter(ids) == Counter({c for _, _, c in plain_components(before)})
        if name == "mixing":
            assert Counter(ids) == Counter(r.doc_id for r in before)
            assert len({(r.mix_slot, r.mix_place) for r in after}) == len(after)
        if name == "sentencepiece":
            encoder = pieces.Encoder(catalog.tokenizer("piece_bpe_32k.model"))
            texts = {r.doc_id: r.text for r in before}
            for r in after:
                assert r.ids == encoder.encode([texts[r.doc_id]])[0].tolist() and len(r.ids) == r.n_tokens
        docs = spark.createDataFrame(after, out.schema)
    got = Counter((r.doc_id, r.mix_slot, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == Counter((r.doc_id, r.mix_slot, r.ids_sha256) for r in after)


def test_stages_on_odd_and_empty_documents(spark, sf, odd_documents, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_documents, sf)
        rows = out.collect()
        assert len(rows) <= odd_documents.count()
        if name == "jaccard_join":
            assert Counter(r.doc_id for r in rows)[1] == 2          # two texts under one id; the repeated row once
        assert stage(spark, no_documents, sf).collect() == []


def test_portions_of_grams_change_no_profile(monkeypatch):
    """Also for one long text without blanks, whose trigrams nearly all differ; its vectors are never held at once."""
    rng = random.Random(1)
    texts = [None, "", "!!", "a", "ab"] + ["".join(rng.choice("abcdé ,.日本") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts.append("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000)))

    def profiles():
        grams = language.grams_of(texts, 256)
        return np.concatenate([grams.profiles(a, min(a + 100, len(texts))) for a in range(0, len(texts), 100)]), grams.kept

    whole, kept = profiles()
    assert kept is None
    monkeypatch.setattr(language, "HELD", 1 << 20)
    at_once, kept = profiles()
    monkeypatch.setattr(language, "HELD", 500)
    monkeypatch.setattr(language, "PLACES", 57)
    assert kept is not None and np.array_equal(whole, at_once) and np.array_equal(whole, profiles()[0])


def test_word_tables_are_bounded_by_characters():
    from reviewlake.llm.jaccard import Shingler
    from reviewlake.llm.shared import WordTable

    added = []
    table = WordTable(added.extend, added.clear, longest=100)
    for i in range(50):
        codes = table.codes([f"{i}" * 40, "b", f"{i}" * 40])
        assert codes[0] == codes[2] and added[codes[0]] == f"{i}" * 40 and sum(map(len, added)) < 300
    shingler, fresh = Shingler(longest=100), Shingler()
    for i in range(20):
        text = f"{'x' * 60}{i} two three four five six"
        assert all(np.array_equal(a, b) for a, b in zip(shingler.sets([text]), fresh.sets([text])))
        assert sum(map(len, shingler.known)) < 300
