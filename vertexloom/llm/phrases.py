"""Phrase collocations, counted with broadcast double-array tries."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import lower_ascii, release_memory, small, written

LEAST_COUNT = 100
LONGEST = 5
TOP = 2000
#: A candidate is dropped for a longer one that has at least this percentage of its occurrences.
ABSORBED = 100
#: What ends a piece of text; words are what stands between spaces and tabs.
PIECE_END = r"[.,;:!?\x0A-\x0D]"
#: Characters that are split into words at once, and words of a block of codes.
SLICE = 1 << 20
BLOCK = 1 << 20
#: Words that a task counts before it passes their counts on.
HELD_WORDS = 300_000
#: Counters of a filter: at least and at most 2 to these powers, 2^16 in a chunk, about one for ``BUCKET_WORDS`` words of the
#: corpus. Filters with too few only let more candidates through.
BUCKET_BITS = (20, 26)
BUCKET_WORDS = 16
CHUNK_BITS = 16
#: Groups of candidates by a hash of their first two words.
GROUPS = 256
#: Phrases of one trie; more of them are dealt to several tries, a pass over the codes each.
TRIE_PHRASES = 1_000_000
#: Parts in which a language's phrases are ranked before the first of each are ranked together.
RANK_PARTS = 64

_END, _GAP = 0, 1  # places of the end of a piece and of the empty string in a vocabulary
_PIECE_ENDS = re.compile(f"{PIECE_END}+")


def _hash(lang: str, words: list[str], seed: int) -> np.ndarray:
    """64-bit codes of a language's words; zero is no word's."""
    head = lang.encode("utf-8", "surrogatepass") + b"\x00"
    return np.array([xxhash.xxh64_intdigest(head + w.encode("utf-8", "surrogatepass"), seed) for w in words], np.uint64).view(np.int64)


def _slices(text: str) -> Iterator[str]:
    """``text`` cut at spaces into slices of about ``SLICE`` characters."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class _Vocabulary:
    """Words of a language that a task has met, with their codes and counts."""

    def __init__(self, lang: str, seed: int):
        self.lang, self.seed = lang, seed
        self.places = {"\n": _END, "": _GAP}
        self.codes = np.zeros(2, np.int64)
        self.counts = np.zeros(2, np.int64)

    def encode(self, text: str) -> np.ndarray:
        words = _PIECE_ENDS.sub(" \n ", text).replace("\t", " ").split(" ")
        places = self.places
        new = list(set(words) - places.keys())
        places.update(zip(new, range(len(places), len(places) + len(new)), strict=True))
        self.codes = np.concatenate([self.codes, _hash(self.lang, new, self.seed)])
        met = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        counts = np.bincount(met, minlength=len(places))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        return self.codes[met[met != _GAP]]


_CODED = "lang string, word string, h long, n long, codes binary, starts int"


def encoded(df: DataFrame, lang_col: str, text_col: str, seed: int, longest: int = LONGEST) -> DataFrame:
    """All words of all texts as 64-bit codes, as a written table with two kinds of rows.

    Counts: ``lang, word, h`` (the code), ``n``, a row for each task and word at least.
    Blocks: ``codes`` (binary, zero between pieces), of which the first ``starts`` begin
    phrases of this block; after them stand the words that such phrases may need.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: dict[str, _Vocabulary] = {}
        waiting: list[np.ndarray] = []
        size = 0

        def rows(lang=None, words=(), h=(), n=(), codes=(), starts=()):
            k = max(len(words), len(codes))
            none = [None] * k
            columns = [pa.array([lang] * k, pa.string()), *[pa.array(v if len(v) else none, t) for v, t in ((words, pa.string()), (h, pa.int64()), (n, pa.int64()), (codes, pa.binary()), (starts, pa.int32()))]]
            return pa.RecordBatch.from_arrays(columns, ["lang", "word", "h", "n", "codes", "starts"])

        def counts() -> Iterator[pa.RecordBatch]:
            for v in vocabularies.values():
                if len(v.places) > 2:
                    yield rows(v.lang, list(v.places)[2:], v.codes[2:], v.counts[2:])
            vocabularies.clear()

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size
            if size >= BLOCK + longest or last and size:
                codes, at = np.concatenate(waiting), 0
                while len(codes) - at >= BLOCK + longest or last and at < len(codes):
                    end = min(at + BLOCK, len(codes))
                    yield rows(codes=[codes[at : end + longest - 1].astype("<i8").tobytes()], starts=[end - at])
                    at = end
                waiting, size = [codes[at:]], len(codes) - at

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, many in texts.items():
                many.append("")  # ends the last piece
                for part in _slices("\n".join(many)):
                    if lang not in vocabularies:
                        vocabularies[lang] = _Vocabulary(lang, seed)
                    codes = vocabularies[lang].encode(part)
                    waiting.append(codes)
                    size += len(codes)
                    yield from blocks(False)
            if sum(len(v.places) for v in vocabularies.values()) > HELD_WORDS:
                yield from counts()
        yield from counts()
        yield from blocks(True)
        release_memory()

    texts = df.select(F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"), lower_ascii(df[text_col]).alias("text"))
    return written(texts.mapInArrow(encode, _CODED), "phrase-codes", rows=1000, megabytes=4)


def _mixed(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    out = (hashes.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(31))) + codes.view(np.uint64)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


@dataclass(frozen=True)
class Filter:
    """Which buckets of hashes let a phrase through, a bit each."""

    bits: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bucket = _bucket(hashes, (8 * len(self.bits)).bit_length() - 1)
        return (self.bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _passes(codes: np.ndarray, starts: int, filters: dict[int, Filter], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phrases that no filter rules out: for each length their starts and hashes.

    A phrase passes if its beginning and its end, a word shorter each, pass the filter of
    their length or, where there is none yet, consist of what passes; then its own filter must
    let it through if there is one.
    """
    hashes = codes
    ok = (codes != 0) & filters[1](_mixed(np.zeros_like(codes), codes))
    for length in range(2, longest + 1):
        ok = ok[:-1] & ok[1:]
        hashes = _mixed(hashes[:-1], codes[length - 1 :])
        at = np.flatnonzero(ok)
        own = hashes[at]
        if length in filters:
            through = filters[length](own)
            ok[at[~through]] = False
            at, own = at[through], own[through]
        begins = at < starts
        yield length, at[begins], own[begins]


class _Counters:
    """Counts of hashes by bucket, up to 255, in numpy, a few million phrases at a time."""

    def __init__(self, bits: int):
        self.bits = bits
        self.total = np.zeros(1 << bits, np.uint8)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(_bucket(hashes, self.bits).astype(np.int32))
        self.size += len(hashes)
        if self.size > 1 << 22:
            self.flush()

    def flush(self) -> None:
        if self.size:
            at, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.total[at] = np.minimum(self.total[at] + n, 255)
            self.waiting, self.size = [], 0

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        """Chunks as they are, or as places and counts, whichever is shorter."""
        self.flush()
        for k, chunk in enumerate(self.total.reshape(-1, 1 << CHUNK_BITS)):
            at = np.flatnonzero(chunk)
            if len(at):
                sparse = 3 * len(at) < len(chunk)
                yield k, b"\x00" + at.astype("<u2").tobytes() + chunk[at].tobytes() if sparse else b"\x01" + chunk.tobytes()


def _unpacked(part: bytes) -> np.ndarray:
    if part[0]:
        return np.frombuffer(part, np.uint8, offset=1).astype(np.int32)
    n = (len(part) - 1) // 3
    out = np.zeros(1 << CHUNK_BITS, np.int32)
    out[np.frombuffer(part, "<u2", n, 1)] = np.frombuffer(part, np.uint8, n, 1 + 2 * n)
    return out


_PARTS = "level int, chunk int, part binary"


def _part_rows(counters: dict[int, _Counters]) -> Iterator[pa.RecordBatch]:
    for level, c in counters.items():
        for k, part in c.chunks():
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["level", "chunk", "part"])


def _filters(parts: DataFrame, least: int, bits: int, levels: range) -> dict[int, Filter]:
    """By level, the buckets whose counts of all tasks together reach ``least`` (255 at most): 2^bits bits each."""
    least = min(least, 255)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for level, k, part in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                have = totals.get((level, k))
                total = np.minimum(_unpacked(part) + (0 if have is None else have), 255)
                totals[(level, k)] = total.astype(np.uint8)
        for (level, k), total in totals.items():
            found = np.packbits(total >= least).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([k], pa.int32()), pa.array([found], pa.binary())], ["level", "chunk", "part"])

    found = {level: np.zeros((1 << bits) // 8, np.uint8) for level in levels}
    width = (1 << CHUNK_BITS) // 8
    for r in parts.repartition("level", "chunk").mapInArrow(add, _PARTS).toLocalIterator():
        found[r.level][r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(bytes(r.part), np.uint8)
    return {level: Filter(bits) for level, bits in found.items()}


@dataclass(frozen=True)
class Trie:
    """A double-array trie over codes: the child of ``state`` by symbol c is ``base[state] + c`` if that is its ``check``.

    Symbols are the places of codes in ``alphabet``, from 1. State 0 is the root.
    """

    alphabet: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accepting: np.ndarray

    @staticmethod
    def build(phrases: np.ndarray) -> tuple[Trie, np.ndarray]:
        """The trie of distinct ``phrases`` (a row each, codes, then zeros), and the state that accepts each.

        Nodes are placed in rounds, those with most children first: every node of one size
        tries a random base, and stays there if all its cells are free and no other asks for
        them.
        """
        alphabet = np.unique(phrases[phrases != 0])
        symbols = np.where(phrases != 0, np.searchsorted(alphabet, phrases) + 1, 0)
        node, count = np.zeros(len(phrases), np.int64), 1
        edges = []
        for column in symbols.T:
            has = np.flatnonzero(column)
            keys, inverse = np.unique(node[has] * (len(alphabet) + 1) + column[has], return_inverse=True)
            edges.append((keys // (len(alphabet) + 1), keys % (len(alphabet) + 1), count + np.arange(len(keys))))
            node[has] = count + inverse
            count += len(keys)
        parent, symbol, child = (np.concatenate(e) for e in zip(*edges, strict=True))
        fan_out = np.bincount(parent, minlength=count)
        first = np.searchsorted(parent, np.arange(count))
        cells = 2 * len(parent) + len(alphabet) + 3
        taken, claimed = np.zeros(cells, bool), np.zeros(cells, np.int64)
        base = np.zeros(count, np.int64)
        random = np.random.default_rng(len(parent))
        for width in np.unique(fan_out[fan_out > 0])[::-1]:
            nodes, rounds = np.flatnonzero(fan_out == width), 0
            while len(nodes):
                rounds += 1
                if rounds % 64 == 0:
                    taken, claimed = np.append(taken, np.zeros(cells // 2, bool)), np.append(claimed, np.zeros(cells // 2, np.int64))
                    cells = len(taken)
                tried = nodes[: max(1, (1 << 22) // width)]
                bases = random.integers(1, cells - len(alphabet), len(tried))
                want = bases[:, None] + symbol[first[tried][:, None] + np.arange(width)]
                free = ~taken[want].any(axis=1)
                order = np.arange(len(tried))
                claimed[want[free]] = order[free][:, None]
                won = free & (claimed[want] == order[:, None]).all(axis=1)
                taken[want[won]] = True
                base[tried[won]] = bases[won]
                nodes = np.concatenate([tried[~won], nodes[len(tried) :]])
        state = np.zeros(count, np.int64)
        state[child] = base[parent] + symbol
        check = np.full(cells, -1, np.int32)
        check[state[child]] = state[parent]
        of_cell = np.zeros(cells, np.int32)
        of_cell[state] = base
        accepting = np.zeros(cells, bool)
        accepting[state[node]] = True
        return Trie(alphabet, of_cell, check, accepting), state[node]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of codes, zero for those that are in no phrase."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def visits(self, codes: np.ndarray, starts: int, longest: int) -> np.ndarray:
        """How often each state accepts: all places advance together, a word at a time, until they leave the trie."""
        symbols = np.append(self.symbols(codes), np.zeros(longest, np.int64))
        at = np.flatnonzero(symbols[:starts])
        state = np.zeros(len(at), np.int64)
        total = np.zeros(len(self.base), np.int64)
        for depth in range(longest):
            symbol = symbols[at + depth]
            onward = self.base[state] + symbol
            there = (symbol > 0) & (self.check[onward] == state)
            at, state = at[there], onward[there].astype(np.int64)
            total += np.bincount(state[self.accepting[state]], minlength=len(total))
        return total


def _distinct(codes: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Starts of one occurrence of each phrase that begins ``at`` some place: exact, word by word."""
    numbers = pd.factorize(codes)[0].astype(np.int64)
    key = numbers[at]
    for k in range(1, length):
        key = pd.factorize(key * (numbers.max(initial=0) + 1) + numbers[at + k])[0].astype(np.int64)
    first = np.unique(key, return_index=True)[1] if len(key) else np.zeros(0, np.int64)
    return at[first]


def _group(phrases: np.ndarray) -> np.ndarray:
    """Groups of phrases by their first two words."""
    return (_mixed(_mixed(np.zeros(len(phrases), np.int64), phrases[:, 0]), phrases[:, 1]) % np.uint64(GROUPS)).astype(np.int64)


class _Phrases:
    """Distinct phrases by length and group."""

    def __init__(self):
        self.held: dict[tuple[int, int], list[np.ndarray]] = {}
        self.rows = 0

    def add(self, length: int, group: int, phrases: np.ndarray) -> None:
        self.held.setdefault((length, group), []).append(phrases)
        self.rows += len(phrases)
        if self.rows > TRIE_PHRASES:
            self.rows = 0
            for key, parts in self.held.items():
                self.held[key] = [self._distinct(key[0], parts)]

    @staticmethod
    def _distinct(length: int, parts: list[np.ndarray]) -> np.ndarray:
        whole = np.ascontiguousarray(np.concatenate(parts))
        return np.unique(whole.view(f"V{8 * length}").ravel()).view(np.int64).reshape(-1, length)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (length, group), parts in self.held.items():
            found = self._distinct(length, parts)
            columns = [pa.array([length], pa.int32()), pa.array([group], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([found.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["length", "group", "n", "phrases"])


_PHRASES = "length int, group int, n long, phrases binary"


def _read_blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
    for block, starts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
        yield np.frombuffer(block.as_buffer(), "<i8").astype(np.int64), starts


def _candidates(blocks: DataFrame, frequent: DataFrame, words: int, least: int, longest: int) -> DataFrame:
    """Phrases whose parts may all be frequent, each once: arrays of codes by length and group (:class:`_Phrases`).

    Filters, upper bounds of counts by hash, stand in for counts: of frequent words, of pairs
    of such, and of longer phrases all of whose pairs pass. What passes the filters of its own
    length and of its shorter phrases is a candidate.
    """
    spark = blocks.sparkSession
    bits = min(max((words // BUCKET_WORDS).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {1: _Counters(bits)}
        for batch in batches:
            codes = np.asarray(batch.column(0)).astype(np.int64)
            counters[1].add(_mixed(np.zeros_like(codes), codes))
        yield from _part_rows(counters)

    def counting(levels: range, sent):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counters = {level: _Counters(bits) for level in levels}
            for batch in batches:
                for codes, starts in _read_blocks(batch):
                    for length, _, hashes in _passes(codes, starts, sent.value, levels[-1]):
                        if length in counters:
                            counters[length].add(hashes)
            yield from _part_rows(counters)
            counters.clear()
            release_memory()

        return count

    filters = _filters(frequent.select("h").mapInArrow(of_words, _PARTS), 1, bits, range(1, 2))
    for levels in (range(2, 3), range(3, longest + 1)):
        if levels:
            sent = spark.sparkContext.broadcast(filters)
            filters = filters | _filters(blocks.mapInArrow(counting(levels, sent), _PARTS), least, bits, levels)
            sent.unpersist()
    sent = spark.sparkContext.broadcast(filters)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Phrases()
        for batch in batches:
            for codes, starts in _read_blocks(batch):
                for length, at, _ in _passes(codes, starts, sent.value, longest):
                    at = _distinct(codes, length, at)
                    group = _group(codes[at[:, None] + np.arange(2)])
                    order = np.argsort(group, kind="stable")
                    phrases = codes[at[order][:, None] + np.arange(length)]
                    for part in np.split(phrases, np.flatnonzero(np.diff(group[order])) + 1) if len(at) else ():
                        found.add(length, int(_group(part[:1])[0]), part)
        yield from found.batches()
        found.held.clear()
        release_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Phrases()
        for batch in batches:
            for length, group, _, phrases in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found.add(length, group, np.frombuffer(phrases, "<i8").astype(np.int64).reshape(-1, length))
        yield from found.batches()

    return written(blocks.mapInArrow(emit, _PHRASES).repartition("group").mapInArrow(merge, _PHRASES), "phrase-candidates")


def _counted(blocks: DataFrame, candidates: DataFrame, least: int, longest: int) -> DataFrame:
    """Candidates with ``least`` occurrences or more: ``phrase`` (its name), ``codes`` (array of long), ``a``."""
    spark = blocks.sparkSession
    total = candidates.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    parts = min(GROUPS, max(1, -(-total * 5 // 4 // TRIE_PHRASES)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for length, group, n, phrases in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                padded = np.zeros((n, longest), np.int64)
                padded[:, :length] = np.frombuffer(phrases, "<i8").reshape(-1, length)
                held.setdefault(group % parts, []).append(padded)
        for part, arrays in held.items():
            phrases = np.concatenate(arrays)
            trie, states = Trie.build(phrases)
            yield from _trie_rows(part, phrases, trie, states)

    dealt = candidates.repartition(parts, F.col("group") % parts)
    tries = written(dealt.mapInArrow(build, "part int, state long, codes array<long>, trie binary"), "phrase-tries", rows=10_000)
    counted = tries.select("part", "state", F.lit(0).cast("long").alias("a")).limit(0)
    there = [r.part for r in tries.select("part").distinct().collect()]
    for part in sorted(there):
        sent = spark.sparkContext.broadcast(bytes(tries.filter((F.col("part") == part) & F.col("state").isNull()).select("trie").collect()[0].trie))

        def count(batches: Iterator[pa.RecordBatch], sent=sent, longest=longest) -> Iterator[pa.RecordBatch]:
            trie: Trie = pickle.loads(sent.value)  # noqa: S301  written by build()
            total = np.zeros(len(trie.base), np.int64)
            for batch in batches:
                for codes, starts in _read_blocks(batch):
                    total += trie.visits(codes, starts, longest)
            yield from _count_rows(total)
            release_memory()

        def add(batches: Iterator[pa.RecordBatch], least=least) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for chunk, places, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    total = totals.setdefault(chunk, np.zeros(1 << CHUNK_BITS, np.int64))
                    total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<i8")
            for chunk, total in totals.items():
                at = np.flatnonzero(total >= least)
                yield pa.RecordBatch.from_arrays([pa.array(at + (chunk << CHUNK_BITS), pa.int64()), pa.array(total[at], pa.int64())], ["state", "a"])

        sums = blocks.mapInArrow(count, "chunk int, places binary, counts binary").repartition("chunk").mapInArrow(add, "state long, a long")
        counted = counted.unionByName(written(sums.withColumn("part", F.lit(part)), "phrase-counts"))
        sent.unpersist()
    named = tries.filter(F.col("state").isNotNull()).select("part", "state", "codes")
    return named.join(counted, ["part", "state"]).select(F.concat_ws(":", "part", "state").alias("phrase"), "codes", "a")


def _count_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of states in chunks: the places that have any, and these."""
    for at in range(0, len(total), 1 << CHUNK_BITS):
        chunk = total[at : at + (1 << CHUNK_BITS)]
        places = np.flatnonzero(chunk)
        if len(places):
            columns = [pa.array([at >> CHUNK_BITS], pa.int32()), pa.array([places.astype("<u2").tobytes()], pa.binary()), pa.array([chunk[places].astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "places", "counts"])


def _trie_rows(part: int, phrases: np.ndarray, trie: Trie, states: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The states of phrases, and one row without a state that holds the trie."""
    names = ["part", "state", "codes", "trie"]
    lengths = (phrases != 0).sum(axis=1)
    for at in range(0, len(states), 10_000):
        own, n = phrases[at : at + 10_000], lengths[at : at + 10_000]
        codes = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(own[own != 0], pa.int64()))
        columns = [pa.array([part] * len(own), pa.int32()), pa.array(states[at : at + 10_000], pa.int64()), codes, pa.nulls(len(own), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)
    columns = [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([pickle.dumps(trie)], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names)


def _words(df: DataFrame, lang_col: str, text_col: str, longest: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of codes, and ``lang, word, h, n`` of all words; codes are taken anew in the rare case that two words share one."""
    for seed in range(10):
        table = encoded(df, lang_col, text_col, seed, longest)
        of_code = table.filter("word is not null").groupBy("h").agg(F.min(F.struct("lang", "word")).alias("first"), F.max(F.struct("lang", "word")).alias("last"), F.sum("n").alias("n"))
        words = written(of_code, "phrase-words")
        if words.filter((F.col("first") != F.col("last")) | (F.col("h") == 0)).isEmpty():
            return table.filter("codes is not null").select("codes", "starts"), words.select("first.lang", "first.word", "h", "n")
    raise RuntimeError("ten seeds gave two words one code each")


def collocations(
    df: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    absorbed: int = ABSORBED,
) -> DataFrame:
    """The most telling phrases of each language: words that stand together more often than their parts would.

    Texts are coded once, a 64-bit number for each word of a language, and checked that no two
    words share one. Candidates are phrases of 2 to ``longest`` words all of whose shorter
    phrases may be frequent (:func:`_candidates`); they make double-array tries of bounded
    size, which are built in tasks and broadcast one after the other; numpy follows all places
    of the text through a trie at the same time, and Spark adds up the tasks' counts. Of the
    ways to cut a phrase in two the lowest score counts: floor(1000 * a * n / (l * r)) for its
    own count a, its parts' l and r and all n words of the language, in exact decimals. Phrases
    inside longer ones with at least ``absorbed`` percent of their occurrences are dropped.

    Returns ``lang, rank`` (from 1), ``phrase, a, l, r, n, score``, at most ``top`` rows a
    language. Defined cases: null texts are empty, null languages are ``und``; equal texts
    count each; a language without frequent phrases has no rows; other columns are not looked
    at; empty input gives no rows.
    """
    blocks, words = _words(df, lang_col, text_col, longest)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= least)
    all_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    counted = _counted(blocks, _candidates(blocks, frequent, all_words, least, longest), least, longest)
    single = counted.select("phrase", "a", F.posexplode("codes").alias("pos", "h")).join(small(frequent.select("lang", "word", "h")), "h")
    gathered = single.groupBy("phrase", "a", "lang").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    phrases = written(gathered.select("lang", F.col("w.word").alias("words"), "a"), "phrases").withColumn("phrase", F.array_join("words", " "))
    known = written(phrases.select("lang", "phrase", F.col("a").alias("n")).unionByName(frequent.select("lang", F.col("word").alias("phrase"), "n")), "phrase-parts")
    known = small(known)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " "))
    cuts = cuts.select("lang", "phrase", "a", "k", "left", "right").join(small(totals), "lang")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    score = F.call_function("div", exact["a"] * 1000 * exact["n"], exact["l"] * exact["r"])
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = phrases.filter(F.size("words") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    longer = inner.groupBy("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
