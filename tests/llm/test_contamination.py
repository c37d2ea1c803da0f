"""Benchmark overlap against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from vertexloom.llm import contamination

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def reference(text, items):
    w = split(text)
    hit, found = set(), set()
    for name, item in items:
        v = split(item)
        if not v:
            continue
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def case(seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "a", "é", "x1", "word", "B"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((1, 5, 13, 14, 30, 60))))) for i in range(12)]
    items += [(90, None), (91, " .,"), (92, items[3][1]), (93, "The, OF... a-É")]
    docs = []
    for i in range(60):
        parts = [" ".join(rnd.choice([*vocabulary, "zz", "yy"]) for _ in range(rnd.randrange(40)))]
        if i % 3 == 0:
            v = split(rnd.choice(items)[1])
            at = rnd.randrange(len(v) + 1)
            parts.append(", ".join(v[at : at + rnd.choice((12, 13, 20))]))
        parts.append(" ".join(rnd.choice(["zz", "yy", "the"]) for _ in range(rnd.randrange(400))))
        docs.append((i, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (102, "a" * 50000), (103, "the " * 5000)], items


@pytest.mark.parametrize(("seed", "limit", "short"), [(1, 200_000, True), (2, 60, True), (3, 200_000, False), (4, 60, False)])
def test_overlap_matches_brute_force(spark, monkeypatch, seed, limit, short):
    monkeypatch.setattr(contamination, "AUTOMATON_WORDS", limit)
    docs, items = case(seed)
    if not short:
        items = [(n, t) for n, t in items if len(split(t)) >= 13]
    d = spark.createDataFrame([(i, t, "v", 3) for i, t in docs], "doc_id long, text string, verdict string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination.benchmark_overlap(d, b).collect()}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == reference(t, items), (i, t)
        assert sum(s.end - s.start for s in r.hit_spans) == r.n_hit
    left = contamination.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {i for i, t in docs if not reference(t, items)[4]}


def test_long_hits_are_cut_out(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"Before, {item.upper()}; after.", "p"), (2, "clean text", "q"), (3, None, "r"), (4, item, "s"), (5, "x " * 900 + " ".join(f"w{i}" for i in range(13)) + " y", "t")]
    d = spark.createDataFrame(docs, "doc_id long, text string, hit_spans string")
    got = contamination.cut_long_hits(d, spark.createDataFrame([("a", item)], "item_id string, text string"))
    assert got.columns == d.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Before, ; after.", 2: "clean text", 3: None, 4: "", 5: docs[4][1]}


def test_overlap_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in contamination.benchmark_overlap(d, b).collect()) == [(0, 0, False), (2, 0, False), (2, 0, False)]
    assert contamination.benchmark_overlap(d.limit(0), b).collect() == []


def test_spans_of_mixed_lengths_keep_every_hit_word(spark):
    w = [f"w{i}" for i in range(20)]
    items = [("a", " ".join(w[:13])), ("b", " ".join(w[14:17])), ("c", " ".join(w[7:20]))]
    automaton = contamination.SuffixAutomaton([(n, contamination.words_of(t)) for n, t in items])
    assert automaton.spans(contamination.words_of(" ".join(w)))[0] == [(0, 20)]
    rnd = random.Random(8)
    for _ in range(300):
        line = [f"v{rnd.randrange(30)}" for _ in range(60)]
        items = [(str(k), " ".join(line[a : a + rnd.choice((1, 2, 3, 6, 13, 15))])) for k, a in enumerate(rnd.sample(range(45), 8))]
        automaton = contamination.SuffixAutomaton([(n, contamination.words_of(t)) for n, t in items])
        spans, found = automaton.spans(contamination.words_of(" ".join(line)))
        n_hit, n_items = reference(" ".join(line), items)[1:3]
        assert (sum(b - a for a, b in spans), len(found)) == (n_hit, n_items)
        assert spans == contamination._merged(spans)
