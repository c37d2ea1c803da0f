"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vertexloom.llm import exact, simhash

SCHEMA = "doc_id long, text string, digest string, code string, id string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(n)]


def texts():
    base = [" ".join(words(n, n)) for n in (0, 1, 2, 3, 4, 30, 200, 5000)]
    near = []
    for k in range(12):
        w = words(200, 200)
        w[k * 7] = "changed"
        near.append(" ".join(w))
    return [None, "", " \t\n", "Ünï Ö", "ünï ö", *base, *base[3:6], base[5].upper(), *near, "a" * 30000, "- -\x0b-"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def reference_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reference_components(codes, distance=3):
    ids = sorted(codes)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(codes[a] ^ codes[b]).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_exact_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in exact.exact_duplicates(frame(spark, rows)).collect()}
    norm = {i: (t or "").translate(ASCII) for i, t in rows}
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert got[0].code == "y" and got[0].id == "z"


def test_exact_compares_content_when_digests_collide(spark):
    rows = [(1, "aa"), (2, "bb"), (3, "AA"), (4, "cc")]
    got = exact.exact_duplicates(frame(spark, rows), digest=lambda t: F.octet_length(t).cast("string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1)}


def test_exact_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "C")]
    marked = exact.exact_duplicates(frame(spark, rows))
    assert sorted((r.keep_id or 0, r.group_size) for r in marked.collect()) == [(0, 2), (0, 2), (1, 3), (1, 3), (1, 3), (7, 2), (7, 2)]
    kept = exact.drop_exact_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "code", "id"]
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect()) == [(0, "b"), (1, "a"), (7, "c")]


def test_exact_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", "x", True), (2, "A", "y", False)], "doc_id long, text string, whole_row string, kept boolean")
    kept = exact.drop_exact_duplicates(df)
    assert kept.columns == df.columns and [(r.doc_id, r.whole_row, r.kept) for r in kept.collect()] == [(2, "y", False)]


def test_exact_empty(spark):
    assert exact.exact_duplicates(frame(spark, [])).collect() == []
    assert exact.drop_exact_duplicates(frame(spark, [])).collect() == []


def test_fingerprints_and_components(spark):
    rows = list(enumerate(texts(), 10))
    got = {r.doc_id: r for r in simhash.simhash_components(frame(spark, rows)).collect()}
    codes = {i: reference_fingerprint(t) for i, t in rows}
    parts = reference_components(codes)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{c:016x}" for i, c in codes.items()}
    assert {i: r.component_id for i, r in got.items()} == parts


@pytest.mark.parametrize("limit", [1024, 8])
def test_links_join_what_all_pairs_join(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "KEY_ROWS", limit)
    rnd = random.Random(3)
    codes = {0, (1 << 64) - 1, 7}
    for _ in range(12):
        c = rnd.getrandbits(64)
        for _ in range(rnd.choice((1, 5, 40))):
            codes.add(c)
            for _ in range(rnd.choice((1, 1, 2, 4))):
                c ^= 1 << rnd.randrange(64)
    ids = dict(enumerate(sorted(codes)))
    signed = {i: int(np.uint64(c).astype(np.int64)) for i, c in ids.items()}
    df = spark.createDataFrame([(0, c) for c in signed.values()] + [(1, c) for c in signed.values()], "series int, code long")
    links = simhash.near_links(df).collect()
    position = {c: i for i, c in signed.items()}
    for series in (0, 1):
        linked = [(position[r.a], position[r.b]) for r in links if r.series == series]
        assert all(bin(ids[a] ^ ids[b]).count("1") <= 3 for a, b in linked)
        root = {i: i for i in ids}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in linked:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {i: find(i) for i in ids} == reference_components(ids)


def test_simhash_empty_and_repeats(spark):
    assert simhash.simhash_components(frame(spark, [])).collect() == []
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t u v")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.simhash_components(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]


def test_near_duplicates_dropped_and_clean_kept(spark):
    rows, i, planted = [], 0, 0
    for g in range(30):
        w = words(150 + 10 * g, 1000 + g)
        rows.append((i, " ".join(w)))
        i += 1
        for k in range(2):
            v = list(w)
            v[(g * 13 + 50 * k) % len(v)] = "altered"
            rows.append((i, " ".join(v)))
            i, planted = i + 1, planted + 1
    rows += [(900, None), (901, ""), (902, "short one"), (903, "short one"), (None, "x y z")]
    left = simhash.drop_near_duplicates(frame(spark, rows))
    kept = {r.doc_id for r in left.collect()}
    firsts = {3 * g for g in range(30)}
    assert firsts | {900, 901, 902, None} <= kept
    assert 903 not in kept
    assert len(kept & set(range(90)) - firsts) <= 3
    assert left.columns == ["doc_id", "text", "digest", "code", "id"]
    assert simhash.drop_near_duplicates(frame(spark, [])).collect() == []


def test_near_duplicates_with_block_edits_match_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"a{k}w{i}" for i in range(rnd.choice((40, 150, 400)))]
        rows.append((10 * k, " ".join(base)))
        block = [f"b{k}w{i}" for i in range(int(len(base) * (0.04, 0.1, 0.15, 0.22, 0.28)[k % 5]))]
        at = (0, len(base) // 2, len(base))[k % 3]
        rows.append((10 * k + 1, " ".join(base[:at] + block + base[at:])))
        rows.append((10 * k + 2, " ".join(base[: len(base) - len(block)])))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and root[a] != root[b] and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == {i for i, r in root.items() if i == r}


def test_near_duplicate_pairs_of_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SALT_ROWS", 5)
    head = " ".join(f"h{i}" for i in range(100))
    rows = [(k, head + " " + " ".join(f"t{k}x{i}" for i in range(9 + k % 9))) for k in range(40)]
    rows += [(100 + k, f"{head} " + " ".join(f"u{k}x{i}" for i in range(300))) for k in range(20)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    joined = {0}
    while more := {i for i in sets if i not in joined and any(alike(sets[i], sets[j]) for j in joined)}:
        joined |= more
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == set(sets) - joined | {0}
