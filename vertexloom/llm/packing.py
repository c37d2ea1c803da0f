"""Packing documents into sequences of fixed length by their length histogram."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from vertexloom.llm.common import small, written

CAPACITY = 1024
#: The id that ends every document.
END_ID = 0
#: Room of less than a pack's 128th part stays as padding: no document is cut for it.
LEAST_GAP = 128
#: A visit to an open pack takes up this share of its room at least, if there are items enough.
VISIT = 8
#: Fixed: how byte-level BPE cuts text before its merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of space of this length are left to the library: the quick way's pattern would go too deep.
LONG_SPACE = 1000


def byte_stand_ins() -> list[str]:
    """The characters that stand for the 256 bytes: printable Latin-1 is itself, the others follow from code point 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class IdReader:
    """Token ids of texts as little-endian unsigned 32-bit integers, those of ``tokenizers``.

    Plain byte-level vocabularies go the quick way, by tiktoken's merging over the same merges
    as ranks. That merges any two tokens whose bytes make a token, and the library only the
    two that the merge names. Both are the same if each token is what its own bytes merge to:
    when its bytes lie in two neighbours, all merges of lower rank inside them are done, which
    are those of the bytes alone, so they are the two that its merge names. This is checked
    for every token. Other vocabularies, and texts with long runs of space, go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        self.specials = {t["content"]: t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))}
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.long_space = re.compile(rf"\s{{{LONG_SPACE}}}")
        plain = (
            model["type"] == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
            and not any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        )
        self.quick = self._ranked(model) if plain else None

    def _ranked(self, model: dict) -> tiktoken.Encoding | None:
        """The merges as ranks, after the single bytes; None if the two ways of merging might differ."""
        vocabulary, stand_in = model["vocab"], byte_stand_ins()
        made = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        tokens = [*stand_in, *made]
        if len(set(tokens)) < len(tokens) or any(t not in vocabulary or len(self.library.model.tokenize(t)) != 1 for t in tokens):
            return None
        byte = {c: b for b, c in enumerate(stand_in)}
        self.of_rank = np.array([vocabulary[t] for t in tokens], "<u4")
        ranks = {bytes(byte[c] for c in t): rank for rank, t in enumerate(tokens)}
        return tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return self.of_rank[np.array(self.quick.encode_ordinary(text), np.int64)].tobytes()

    def ids(self, text: str) -> bytes:
        if self.quick is None or self.long_space.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += [self._plain(text[at : found.start()]), np.array([self.specials[found.group()]], "<u4").tobytes()]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])


@lru_cache(maxsize=2)
def _reader(name: str) -> IdReader:
    return IdReader(SparkFiles.get(name))


@dataclass(frozen=True)
class Item:
    """Of tails of length ``tail``, those from rank ``rank`` on, ``copies`` of them in each pack: ``size`` ids from ``start``."""

    tail: int
    rank: int
    start: int
    size: int
    copies: int = 1


@dataclass
class Packs:
    """``count`` packs that are filled alike, with ``room`` left in each; less than ``least`` of it isn't filled."""

    count: int
    room: int
    least: int = 1
    items: list[Item] = field(default_factory=list)

    def split(self, first: int) -> Packs | None:
        """Keep the ``first`` packs; the others, if there are any."""
        if first == self.count:
            return None
        rest = Packs(self.count - first, self.room, self.least, [replace(i, rank=i.rank + first * i.copies) for i in self.items])
        self.count = first
        return rest


class _Open:
    """Groups of packs with room, the emptiest first."""

    def __init__(self):
        self.by_room: dict[int, list[Packs]] = {}
        self.full: list[Packs] = []

    def put(self, packs: Packs | None) -> None:
        if packs is not None:
            (self.by_room.setdefault(packs.room, []) if packs.room >= packs.least else self.full).append(packs)

    def emptiest(self) -> Packs | None:
        if not self.by_room:
            return None
        room = max(self.by_room)
        packs = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
        return packs

    def groups(self) -> list[Packs]:
        return [p for room in sorted(self.by_room, reverse=True) for p in self.by_room[room]]


def _place(packs: Packs, tail: int, rank: int, start: int, size: int, n: int, opened: _Open) -> int:
    """Put items of ``size`` into the group, several at once where the room is large; how many it took."""
    copies = min(max(1, packs.room // (VISIT * size)), n)
    opened.put(packs.split(min(packs.count, n // copies)))
    packs.items.append(Item(tail, rank, start, size, copies))
    packs.room -= size * copies
    opened.put(packs)
    return packs.count * copies


def shortest_pack_first(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[Packs]:
    """Packs for ``histogram[length]`` tails of each length (1 to ``capacity`` - 1), all of them.

    Lengths are placed longest first, a whole group of equal packs at a time, always into the
    shortest packs; a new group is opened only if the shortest has no room. What the work
    costs depends on the capacity, not on the counts. Then the shortest packs are taken apart
    until what they held just fills the room of the others: their tails are poured into it,
    longest first and shortest pack first again, and cut where a pack ends. Gaps of less than
    a ``LEAST_GAP``-th of the capacity stay. What is left over makes whole sequences, and at
    the end some whose lengths are powers of two, which need no padding.
    """
    least = max(1, capacity // LEAST_GAP)
    opened = _Open()
    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            packs = opened.emptiest()
            if packs is None or packs.room < length:
                opened.put(packs)
                packs = Packs(n, capacity)
            took = _place(packs, length, rank, 0, length, n, opened)
            rank, n = rank + took, n - took
    kept, pool = _take_apart(opened, capacity, least)
    while pool:
        packs = kept.emptiest()
        if packs is None:
            _open_for(sum(k[0] * n for k, n in pool.items()), capacity, least, kept)
            continue
        key = max(pool)
        size, tail, start, rank = key
        n = pool.pop(key)
        part = min(size, packs.room)
        took = _place(packs, tail, rank, start, part, n, kept)
        if part < size:
            pool[(size - part, tail, start + part, rank)] = took
        if n > took:
            pool[(size, tail, start, rank + took)] = n - took
    return kept.full


def _take_apart(opened: _Open, capacity: int, least: int) -> tuple[_Open, Counter]:
    """Packs to keep, and the tails of the shortest ones: (size, tail, start, first rank) and how many."""
    shortest = opened.groups()
    for packs in shortest:
        packs.least = least
    gaps = sum(p.count * p.room for p in shortest if p.room >= least)
    kept, pool, held = _Open(), Counter(), 0
    kept.full = opened.full
    for packs in shortest:
        rest: Packs | None = packs
        if packs.room >= least and held < gaps:  # one more taken apart brings a capacity nearer
            apart = min(packs.count, -(-(gaps - held) // capacity))
            rest = packs.split(apart)
            held, gaps = held + apart * (capacity - packs.room), gaps - apart * packs.room
            for i in packs.items:
                pool[(i.size, i.tail, i.start, i.rank)] = apart * i.copies
        kept.put(rest)
    return kept, pool


def _open_for(ids: int, capacity: int, least: int, kept: _Open) -> None:
    """New packs for as many ids: whole ones, or else powers of two."""
    if ids >= capacity:
        kept.put(Packs(ids // capacity, capacity, least))
    else:
        for bit in range(ids.bit_length()):
            if ids >> bit & 1:
                kept.put(Packs(1, 1 << bit))


def slots(groups: Sequence[Packs]) -> list[tuple[int, ...]]:
    """A row for each item: tail, first and last rank, copies, start, size, first sequence, offset there."""
    out, sequence = [], 0
    for packs in groups:
        offset = 0
        for i in packs.items:
            out.append((i.tail, i.rank, i.rank + packs.count * i.copies - 1, i.copies, i.start, i.size, sequence, offset))
            offset += i.size * i.copies
        sequence += packs.count
    return out


def tokenized(df: DataFrame, vocabulary: str, text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The columns of ``df`` but its text, and the ids of every text with ``end_id`` after them, as a written table.

    ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``tail`` (tokens beyond
    the last full sequence), and numbers that the task gives: ``part`` (itself), ``full_begin``
    (full sequences before the row's), ``rank`` (rows before with the same tail).
    """
    spark = df.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]
    end = np.array([end_id], "<u4").tobytes()
    new = [
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("tail", T.IntegerType()),
        T.StructField("part", T.IntegerType()), T.StructField("full_begin", T.LongType()), T.StructField("rank", T.LongType()),
    ]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part = _reader(name), TaskContext.get().partitionId()
        full, ranks = 0, Counter()
        for batch in batches:
            ids = [reader.ids(t or "") + end for t in batch.column(batch.num_columns - 1).to_pylist()]
            rows = []
            for i in ids:
                n = len(i) // 4
                tail = n % capacity
                rows.append((n, tail, full, ranks[tail]))
                full += n // capacity
                ranks[tail] += 1
            n, tails, begins, of_tail = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(tails, pa.int32()),
                    pa.array([part] * len(ids), pa.int32()), pa.array(begins, pa.int64()), pa.array(of_tail, pa.int64()),
                ],
                [*batch.schema.names[:-1], *[f.name for f in new]],
            )

    others = [c for c in df.columns if c != text_col]
    schema = T.StructType([*[df.schema[c] for c in others], *new])
    return written(df.select(*others, text_col).mapInArrow(read, schema), "packing", rows=1000, megabytes=4)


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack the token ids of every text, each with ``end_id`` after it, into sequences of ``capacity`` ids.

    Args:
        vocabulary: path of the vocabulary's .json file on the driver; it is sent to the
            executors as a file.
        capacity: a power of two.

    The ids are written once, with their texts' places in the writing task. What fills whole
    sequences is cut off first; the tails that are left are counted by length, and their packs
    are planned from that histogram (:func:`shortest_pack_first`), at most ``capacity`` rows
    at the driver. The plan goes back to the documents by their ranks among the tails of one
    length: the ranks in their task, after those of the tasks before. No document is moved for
    that, and tails of one length are spread over all tasks that hold them.

    Returns a row for each piece: the id column, ``start`` (ids of the document before it),
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens`` (with
    ``end_id``), ``sequence_id`` (from 0 without gaps), ``offset`` (its place there). Sequences
    lack less than a ``LEAST_GAP``-th of ``capacity``, or have a power of two of ids; of the
    latter there are fewer than ``capacity`` has bits. :func:`sequences` puts pieces together.

    Defined cases: null and empty texts are the end id alone; rows that repeat an id are
    documents of their own; the id may be null; other columns are not looked at; empty input
    gives no rows.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    spark = df.sparkSession
    table = tokenized(df.select(df[id_col].alias("in_id"), df[text_col].alias("in_text")), vocabulary, "in_text", capacity, end_id)
    tails = table.filter("tail > 0").groupBy("part", "tail").agg(F.count("*").alias("n"))
    plan = slots(shortest_pack_first({r.tail: r.n for r in tails.groupBy("tail").agg(F.sum("n").alias("n")).collect()}, capacity))
    planned = spark.createDataFrame(
        plan, "tail int, first_rank long, last_rank long, copies int, slot_start int, slot_size int, slot_sequence long, slot_offset int"
    )
    full = table.groupBy("part").agg(F.sum(F.expr(f"doc_tokens div {capacity}")).alias("part_full"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each task
    parts = small(full.select("part", F.coalesce(F.sum("part_full").over(so_far), F.lit(0)).alias("part_begin")))
    all_full = full.agg(F.coalesce(F.sum("part_full"), F.lit(0)).alias("n")).first().n
    of_tail = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = small(tails.select("part", "tail", F.coalesce(F.sum("n").over(of_tail), F.lit(0)).alias("rank_begin")))

    def piece(ids_from, size):
        return F.substring("ids", (ids_from * 4 + 1).cast("int"), (size * 4).cast("int"))

    wide = F.lit(capacity)
    cut = table.filter(F.col("doc_tokens") >= capacity).join(parts, "part")
    cut = cut.withColumn("nth", F.explode(F.sequence(F.lit(0), F.expr(f"doc_tokens div {capacity} - 1").cast("int"))))
    whole = cut.select(
        F.col("in_id").alias(id_col), (F.col("nth") * wide).cast("long").alias("start"), wide.cast("long").alias("length"), piece(F.col("nth") * wide, wide).alias("ids"),
        "doc_tokens", (F.col("part_begin") + F.col("full_begin") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    ranked = table.filter("tail > 0").join(ranks, ["part", "tail"]).withColumn("rank", F.col("rank_begin") + F.col("rank"))
    placed = ranked.join(small(planned), "tail").filter("rank between first_rank and last_rank")
    nth, start = F.col("rank") - F.col("first_rank"), F.col("doc_tokens") - F.col("tail") + F.col("slot_start")
    rest = placed.select(
        F.col("in_id").alias(id_col), start.alias("start"), F.col("slot_size").cast("long").alias("length"), piece(start, F.col("slot_size")).alias("ids"),
        "doc_tokens", (F.lit(all_full) + F.col("slot_sequence") + F.floor(nth / F.col("copies"))).alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(nth, F.col("copies")) * F.col("slot_size")).alias("offset"),
    )
    return whole.unionByName(rest)


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences of :func:`pack_documents`, at most ``capacity`` ids each.

    Returns ``sequence_id``, ``ids`` (binary, the pieces' joined), ``length``, and ``pieces``
    (array of id, start and length, in their order), with which attention can be kept within
    documents.
    """
    piece = F.struct("offset", "ids", F.col(id_col).alias("id"), "start", "length")
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return joined.select(
        "sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
        F.transform("p", lambda x: F.struct(x["id"].alias(id_col), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
    )
