"""Collocations against counting by brute force, and the trie against a dictionary."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from vertexloom.llm import phrases


def brute_force(rows, least, longest=5, top=2000, absorbed=100):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[(lang, *words[i : i + k])] += 1
    frequent = {p: a for p, a in counts.items() if a >= least}
    out = {}
    for (lang, *words), a in frequent.items():
        if len(words) < 2:
            continue
        score, _, left, right = min(
            (1000 * a * n[lang] // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k, counts[(lang, *words[:k])], counts[(lang, *words[k:])]) for k in range(1, len(words))
        )
        phrase = " ".join(words)
        longer = [b for (other, *w), b in frequent.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not any(100 * b >= absorbed * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, left, right, n[lang], score))
    return sorted((lang, rank, *row[3:]) for lang, found in out.items() for rank, row in enumerate(sorted(found)[:top], 1))


def rows_of(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def invented(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "C", "é", "Dd", "e\x00", "\U0001f642", "ß", "zz", "-"]
    texts = []
    for _ in range(120):
        parts = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.5:
            parts[3:3] = ["New", "York", "City", "hall", "clock", "tower"]
        texts.append("".join(p + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "; "]) for p in parts))
    return [(rnd.choice(["en", "en", "fr", None, "und"]), t) for t in texts]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, monkeypatch, seed):
    rows = [*invented(seed), ("en", None), (None, ""), ("en", "x" * 5000), ("de", "one word")] + [("es", "buenos dias a todos los amigos")] * 40
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "lang string, text string, phrase int, words string").repartition(3)
    got = rows_of(df, least=12)
    assert got == brute_force(rows, 12) and {r[0] for r in got} >= {"en", "und", "es"}
    assert rows_of(df, least=12, longest=3, top=5, absorbed=60) == brute_force(rows, 12, 3, 5, 60)
    assert rows_of(df, least=10**6) == [] and rows_of(df.limit(0)) == []


def test_blocks_and_slices_lose_no_phrase(spark, monkeypatch):
    """Encoded in the driver with tiny slices, blocks and vocabularies: the same codes in the same order."""
    for name, value in (("SLICE", 40), ("BLOCK", 7), ("HELD_WORDS", 5)):
        monkeypatch.setattr(phrases, name, value)
    rows = invented(9)
    whole = " \n ".join(t for _, t in rows)
    assert "".join(phrases._slices(whole)) == whole
    vocabulary = phrases._Vocabulary("en", 3)
    cut = np.concatenate([vocabulary.encode(s) for s in phrases._slices(whole)])
    assert (cut == phrases._Vocabulary("en", 3).encode(whole)).all()


@pytest.mark.parametrize("seed", range(6))
def test_trie_counts_what_it_holds(seed):
    rnd = np.random.default_rng(seed)
    codes = rnd.choice(np.append(rnd.integers(-(2**62), 2**62, 30), 0), 5000, p=[*[0.9 / 30] * 30, 0.1])
    held = {tuple(codes[i : i + k]) for i in rnd.integers(0, 4900, 400) for k in (2, 3, 5) if 0 not in codes[i : i + k]}
    table = np.zeros((len(held), 5), np.int64)
    for row, p in zip(table, held, strict=True):
        row[: len(p)] = p
    trie, states = phrases.Trie.build(table)
    assert len(set(states.tolist())) == len(held)
    starts = 4000
    visits = trie.visits(codes, starts, 5)
    want = Counter(tuple(codes[i : i + k]) for i in range(starts) for k in (2, 3, 5))
    assert [int(visits[s]) for s in states] == [want[tuple(r[r != 0])] for r in table]
    assert visits.sum() == visits[states].sum()


def test_one_trie_or_many(spark, monkeypatch):
    rows = invented(4)
    df = spark.createDataFrame(rows, "lang string, text string")
    whole = rows_of(df, least=8)
    monkeypatch.setattr(phrases, "TRIE_PHRASES", 50)
    assert rows_of(df, least=8) == whole == brute_force(rows, 8)


def test_filters_of_dense_and_sparse_chunks():
    bits = 22
    counters = phrases._Counters(bits)
    buckets = np.concatenate([np.arange(70000), np.arange(0, 1 << bits, 5000), np.full(300, 9)])
    hashes = (buckets.astype(np.uint64) << np.uint64(64 - bits)).view(np.int64)
    for _ in range(2):
        counters.add(hashes)
    total = 2 * np.bincount(buckets, minlength=1 << bits)
    for k, part in counters.chunks():
        assert (phrases._unpacked(part) == np.minimum(total[k << 16 : (k + 1) << 16], 255)).all()
    through = phrases.Filter(np.packbits(total >= 4))
    assert (through(hashes) == (total[buckets] >= 4)).all() and not through(hashes).all()
