"""Language identification: kernel against its definition, held-out accuracy, defined cases."""

from __future__ import annotations

import zlib

import numpy as np

from vertexloom.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_kernel_is_shared_ngrams_over_root_of_numbers():
    texts, langs = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "an other one"], ["en", "fr", "de", "en"]
    model = langid.learn(texts, langs)

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    marks = [t for lang in sorted(set(langs)) for t, x in zip(texts, langs, strict=True) if x == lang]
    kernel = model.kernel(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(marks):
            assert abs(kernel[i, j] - len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))) < 1e-5
    assert model.predict(texts)[0] == langs


def test_held_out_accuracy_and_contract(spark):
    df = spark.read.parquet(DOCS)
    rows = langid.identify(df).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert len(rows) == df.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) >= 0.97


def test_defined_cases(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 !?", "en", 1), (4, "x" * 100_000, "en", 1), (4, "x" * 100_000, None, 1)]
    rows += [(i, "plain words here", "en", 1) for i in range(10, 20)] + [(i, "des mots simples ici", "fr", 1) for i in range(20, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(df)
    assert got.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    by = {r.doc_id: r for r in got.collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert by[10].lang_pred == "en" and by[20].lang_pred == "fr"
    assert langid.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).filter("lang is null")).collect()} == {"und"}


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeßжлφ"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 80, 300)] + ["", "x"]
    model = langid.learn(texts, ["a", "b", "a", "b", "a", "b"])
    whole = model.presence(texts, model.letters, model.finder)
    for chunk in (1, 7, 100):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert (model.presence(texts, model.letters, model.finder) == whole).all()


def test_finder_is_a_dictionary():
    codes = np.unique(np.random.default_rng(3).integers(0, 1 << 44, 6000))
    finder = langid.Finder.of(codes)
    asked = np.concatenate([codes, np.random.default_rng(4).integers(0, 1 << 44, 20000)])
    at = {c: i + 1 for i, c in enumerate(codes.tolist())}
    assert finder.columns(asked).tolist() == [at.get(c, 0) for c in asked.tolist()]


def test_many_languages_and_scripts():
    """Each of 260 languages, a script of 30 letters of its own to most, is told; none is left out for being rare."""
    rng = np.random.default_rng(1)
    letters = [chr(0x4E00 + i) for i in range(9000)]
    words = {f"l{n}": ["".join(rng.choice(letters[n * 30 : n * 30 + 30], 3)) for _ in range(30)] for n in range(260)}
    text = lambda lang: " ".join(rng.choice(words[lang], 12))
    langs = [lang for lang in words for _ in range(5)]
    model = langid.learn([text(lang) for lang in langs], langs)
    assert len(model.languages) == 260
    assert model.predict([text(lang) for lang in words])[0] == list(words)
