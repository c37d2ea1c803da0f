"""Packing against the library's ids, and plans against what they were asked to pack."""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vertexloom.llm import packing, registry

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(12))
def test_plan_takes_every_id_of_every_tail_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 2, 16, 64])
    histogram = {rnd.randint(1, capacity - 1): rnd.choice([1, 2, 7, 40]) for _ in range(rnd.choice([0, 1, 3, 60]))} if capacity > 1 else {}
    groups = packing.shortest_pack_first(histogram, capacity)
    fills, taken = {}, {(t, r): [] for t, n in histogram.items() for r in range(n)}
    for tail, first, last, copies, start, size, sequence, offset in packing.slots(groups):
        for rank in range(first, last + 1):
            at, nth = divmod(rank - first, copies)
            fills.setdefault(sequence + at, []).append((offset + nth * size, size))
            taken[(tail, rank)].append((start, size))
    for (tail, _), pieces in taken.items():
        assert [p for s, n in sorted(pieces) for p in range(s, s + n)] == list(range(tail))
    assert sorted(fills) == list(range(len(fills)))
    short = []
    for pieces in fills.values():
        held = [p for s, n in sorted(pieces) for p in range(s, s + n)]
        assert held == list(range(len(held))) and len(held) <= capacity
        short += [len(held)] * (len(held) < capacity)
    assert len(short) == len(set(short)) and all(n & (n - 1) == 0 for n in short)


def test_plan_of_large_counts_is_small():
    groups = packing.shortest_pack_first({n: 10**12 + n for n in range(1, 1024)})
    assert len(packing.slots(groups)) < 200_000
    assert sum(p.count * i.size * i.copies for p in groups for i in p.items) == sum(n * (10**12 + n) for n in range(1, 1024))


def test_ids_are_those_of_the_library():
    reader, library = packing.IdReader(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert reader.quick
    rnd = random.Random(5)
    parts = ["a", "B7", "é", "don't", "'s", "...", "<|endoftext|>", "12", "\x1c", "\x1f", "漢字", "🙂", "aaaa", "hehehe"] + list(" \t\n\r\x0b\x85\xa0\u1680\u2003\u3000\ufeff")
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(3000)] + ["".join(rnd.choices("abcehinorstu ", k=400)) for _ in range(300)]
    texts += ["", " ", "\n\n", "x" * 50000 + "  \n y", "<|endoftext|> <|endoftext|>\n", " " * 200000 + "a <|endoftext|>", "\n" * 999 + "b"]
    for text in texts:
        assert np.frombuffer(reader.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:200])


def test_other_vocabularies_go_to_the_library(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    reader, library = packing.IdReader(path), Tokenizer.from_file(path)
    assert reader.quick is None
    for text in ("Some  Words, and MORE.", ""):
        assert np.frombuffer(reader.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    # "abc" is merged from "a" and "bc", but its bytes merge to "ab" and "c": the quick way would join these.
    tokens = [*packing.byte_stand_ins(), "ab", "bc", "abc"]
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": ["a b", "b c", "a bc"]}}))
    reader = packing.IdReader(str(odd))
    assert reader.quick is None
    assert np.frombuffer(reader.ids("abc"), "<u4").tolist() == [256, ord("c")]


def held(pieces, texts, capacity=1024):
    """Checks pieces (with ids) of documents against the library; returns the sequences' fills."""
    library = Tokenizer.from_file(VOCABULARY)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length and want[p.doc_id][p.start : p.start + p.length] == ids and p.doc_tokens == len(want[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert by_doc.keys() == want.keys()
    for i, parts in by_doc.items():
        assert [x for s, n in sorted(parts) for x in range(s, s + n)] == list(range(len(want[i])))
    fills = {}
    for s, parts in by_sequence.items():
        assert [x for o, n in sorted(parts) for x in range(o, o + n)] == list(range(fills.setdefault(s, sum(n for _, n in parts))))
        assert fills[s] <= capacity
    assert sorted(fills) == list(range(len(fills)))
    return fills


def test_query_packs_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack_documents(docs, VOCABULARY).collect()
    fills = held(pieces, {r.doc_id: r.text for r in docs.collect()})
    assert sum(1024 - n for n in fills.values() if n & (n - 1)) < 0.005 * sum(fills.values())
    short = [n for n in fills.values() if n <= 1024 - 8]
    assert len(short) <= 10 and all(n & (n - 1) == 0 for n in short)
    rows = registry.QUERIES["op13_packing"](spark, SF)
    assert rows.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    of_piece = {(p.doc_id, p.start): zlib.crc32(bytes(p.ids)) for p in pieces}
    rows = rows.collect()
    sums = {}
    ids = {(p.doc_id, p.start): bytes(p.ids) for p in pieces}
    for r in rows:  # another run may cut elsewhere
        assert of_piece.get((r.doc_id, r.start), r.ids_crc32) == r.ids_crc32 or len(ids[(r.doc_id, r.start)]) != 4 * r.length
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == {p.doc_id: p.doc_tokens for p in pieces}


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "word " * 3000, "z"), (4, "  \n ", None), (5, "<|endoftext|> a", "")] + [(10 + i, "the same text here", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    assert all(n == 64 or n & (n - 1) == 0 for n in held(packing.pack_documents(df, VOCABULARY, capacity=64).collect(), {r[0]: r[1] for r in rows}, 64).values())
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c")], "tail long, start string")
    got = packing.pack_documents(twice, VOCABULARY, id_col="tail", text_col="start")
    assert got.columns[0] == "tail" and sorted((str(r.tail), r.length, r.doc_tokens) for r in got.collect()) in ([("7", 2, 2), ("None", 3, 3), ("None", 3, 3)],)
    assert packing.pack_documents(df.limit(0), VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(df, VOCABULARY, capacity=1000)


def test_sequences_join_their_pieces(spark):
    df = spark.createDataFrame([(i, "w " * (i * 7 % 50)) for i in range(200)], "doc_id long, text string")
    pieces = packing.pack_documents(df, VOCABULARY, capacity=64).cache()
    of_sequence = {}
    for p in pieces.collect():
        of_sequence.setdefault(p.sequence_id, []).append((p.offset, bytes(p.ids), p.doc_id, p.start))
    got = packing.sequences(pieces).collect()
    assert len(got) == len(of_sequence)
    for s in got:
        parts = sorted(of_sequence[s.sequence_id])
        assert bytes(s.ids) == b"".join(p[1] for p in parts) and s.length * 4 == len(s.ids)
        assert [(p.doc_id, p.start) for p in s.pieces] == [(p[2], p[3]) for p in parts]
