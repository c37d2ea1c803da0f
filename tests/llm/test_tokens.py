"""Token counts against the library itself."""

from __future__ import annotations

import json
import random

import public_tokenizers
from tokenizers import Tokenizer

from vertexloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def samples():
    rnd = random.Random(1)
    alphabet = "etaoin shrdlu,.!'’\n\t  \x0b\x1c\x1f\x85\xa0éüñß中文字😀👍🏽٣²½Ⅷ0123456789ABCxyz|$%&*# ​　"
    out = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaa", "a" * 30000, " " * 5000]
    out += ["ab" * 999, "\n\n\n  x", "don't I'LL we've 'sx", "é" * 50, "\U0010ffff�"]
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.choice((1, 5, 50, 400)))) for _ in range(600)]
    out += ["".join(rnd.choice("abcde ") for _ in range(2000)) for _ in range(5)]
    return out


def test_counts_match_the_library():
    library = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        counter = tokens.TokenCounter(json.load(f))
    texts = samples()
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = counter.count(texts)
    assert [(t, a, b) for t, a, b in zip(texts, got, expected, strict=True) if a != b] == []


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 10)
    library = Tokenizer.from_file(PATH)
    texts = [*samples()[:60], None, "word " * 2000, "word " * 2000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in tokens.token_counts(df, PATH).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert tokens.token_counts(df.limit(0), PATH).collect() == []
