"""Benchmark passages in documents, found with a generalised suffix automaton of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.llm.common import arrow_batches, release_memory, shield

#: Consecutive item words that make a window.
WINDOW = 13
#: A document is contaminated if 1 in this many of its words is hit.
SHARE = 20
#: Benchmark words in one automaton, which is sent to the executors; larger benchmarks take several, one after another.
AUTOMATON_WORDS = 200_000
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: digits, A-Z lower-cased, and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """All word sequences that occur in the items; one state per set of places where they end."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for name, words in items]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        #: Windows by (state, length): the items that they are of.
        self.windows: dict[tuple[int, int], set[str]] = {}
        self.least = window
        for name, word_ids in coded:
            size = min(window, len(word_ids))
            self.least = min(self.least, size)
            for state in self._ends(word_ids, size):
                self.windows.setdefault((state, size), set()).add(name)
        sizes = sorted({size for _, size in self.windows})
        #: For each state the windows that end its sequences: (length, items), short ones first.
        self.found: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple((size, frozenset(self.windows[state, size])) for size in sizes if (state, size) in self.windows)
            self.found[state] = self.found[self.link[state]] + own

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, source: int, w: int, target: int) -> int:
        copy = self._new(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while source != -1 and self.next[source].get(w) == target:
            self.next[source][w] = copy
            source = self.link[source]
        return copy

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:  # another item has this sequence
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, w, known)
        state = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and w not in self.next[at]:
            self.next[at][w] = state
            at = self.link[at]
        if at != -1:
            known = self.next[at][w]
            self.link[state] = known if self.length[known] == self.length[at] + 1 else self._clone(at, w, known)
        return state

    def walk(self, word_ids: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest sequence of the items that ends at each word."""
        state = length = 0
        edges, link, lengths = self.next, self.link, self.length
        for w in word_ids:
            while state and w not in edges[state]:
                state = link[state]
                length = lengths[state]
            if w in edges[state]:
                state = edges[state][w]
                length += 1
            yield state, length

    def _ends(self, word_ids: list[int], size: int) -> Iterator[int]:
        for state, length in self.walk(word_ids):
            if size and length >= size:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                yield state

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges (end exclusive) that windows cover, and the items that they are of."""
        get, least = self.vocabulary.get, self.least
        ids = [get(w, 0) for w in words]
        out: list[tuple[int, int]] = []
        items: set[str] = set()
        begin, n = 0, len(ids)
        while begin < n:
            try:
                stop = ids.index(0, begin)  # words of no item end every match
            except ValueError:
                stop = n
            if stop - begin >= least:
                for i, (state, length) in enumerate(self.walk(ids[begin:stop]), begin + 1):
                    if length >= least:
                        for size, names in self.found[state]:
                            if size > length:
                                break
                            items |= names
                            if out and i - size <= out[-1][1]:
                                a = i - size
                                while len(out) > 1 and a <= out[-2][1]:
                                    a = min(a, out.pop(-2)[0])
                                out[-1] = (min(a, out[-1][0]), i)
                            else:
                                out.append((i - size, i))
            begin = stop + 1
        return out, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[SuffixAutomaton]:
    """Automata over the items, each of a bounded number of words, in the order of ids."""
    inner, col, _ = shield(benchmark)
    items = inner.select(col(item_col).cast("string").alias("item"), col(text_col).alias("text")).filter("text is not null")
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.orderBy("item").toLocalIterator():
        words = words_of(row.text)
        if not words:
            continue
        if held and size + len(words) > AUTOMATON_WORDS:
            yield SuffixAutomaton(held, window)
            held, size = [], 0
        held.append((row.item or "", words))
        size += len(words)
    if held or not size:
        yield SuffixAutomaton(held, window)


def benchmark_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
) -> DataFrame:
    """How much of each document the windows of the benchmark cover.

    A window is ``window`` consecutive words of an item, or all of a shorter one. Documents
    are streamed, a batch at a time, through a suffix automaton of the items that follows the
    longest match; only runs of benchmark words are followed. The automaton holds at most
    ``AUTOMATON_WORDS`` words; a larger benchmark is cut into several by item id, documents
    pass through each, and the covered ranges are united before they are counted.

    Returns the columns of ``docs`` (those that clash with the new names give way) and
    ``n_words, n_hit, n_items`` (long), ``items_sha256`` (of the ids that occur, as strings,
    sorted, comma-joined), ``contaminated`` (a hit word, and one word in ``share`` or more
    hit) and ``hit_spans`` (array of word ranges, end exclusive).

    Defined cases: null texts have no words; items without words have no windows; a null item
    id counts as the empty string; an empty benchmark hits nothing; repeated items count
    once; rows with equal ids are judged one by one. Empty input gives no rows.
    """
    arrow_batches(docs.sparkSession)
    inner, col, restored = shield(docs)
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        judged = inner.withColumn("verdict", _verdict(_overlaps(docs, first)(col(text_col)), share))
    else:
        keys = [col(id_col).alias("key"), F.xxhash64(col(text_col)).alias("text_key")]
        parts = [cut(inner.select(*keys, _overlaps(docs, x)(col(text_col)).alias("o")).distinct()) for x in (first, second)]
        for block in blocks:
            parts.append(cut(inner.select(*keys, _overlaps(docs, block)(col(text_col)).alias("o")).distinct()))
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        # One row for a block, so the lists are as short as the benchmark has blocks.
        found = union.groupBy("key", "text_key").agg(F.collect_list("o").alias("o"))
        both = found.select("key", "text_key", _verdict(_united(F.col("o")), share).alias("verdict"))
        judged = inner.join(both, col(id_col).eqNullSafe(F.col("key")) & (F.xxhash64(col(text_col)) == F.col("text_key")))
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]
    return judged.select(*[c for c, name in zip(restored, docs.columns, strict=True) if name not in new], "verdict.*")


_OVERLAP = "struct<n_words:long,items:array<string>,spans:array<struct<start:int,end:int>>>"


def _overlaps(docs: DataFrame, automaton: SuffixAutomaton):  # noqa: ANN202
    """A function of a text: its number of words, the items that occur and the ranges they cover."""
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.pandas_udf(_OVERLAP)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                words = words_of(t)
                spans, items = sent.value.spans(words)
                rows.append((len(words), sorted(items), [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=["n_words", "items", "spans"])
        release_memory()

    return of


def _united(overlaps: Column) -> Column:
    """What several blocks found, as one overlap."""

    @F.pandas_udf(_OVERLAP)
    def of(found: pd.Series) -> pd.DataFrame:
        rows = []
        for parts in found:
            spans = _merged([(s["start"], s["end"]) for p in parts for s in p["spans"]])
            items = sorted({x for p in parts for x in p["items"]})
            rows.append((parts[0]["n_words"], items, [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(rows, columns=["n_words", "items", "spans"])

    return of(overlaps)


def _verdict(overlap: Column, share: int) -> Column:
    hit = F.aggregate(overlap["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return F.struct(
        overlap["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(overlap["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(overlap["items"], ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= overlap["n_words"])).alias("contaminated"),
        overlap["spans"].alias("hit_spans"),
    )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns and whole texts.

    Defined cases: as :func:`benchmark_overlap`; columns of any name stay as they are; null
    texts have no words and stay; with an empty benchmark all stay.
    """
    inner, _, restored = shield(docs)
    names = [f"in_{i}" for i in range(len(docs.columns))]
    return benchmark_overlap(inner, benchmark, id_col=names[0], text_col=names[docs.columns.index(text_col)]).filter("not contaminated").select(*restored)


def without_hits(text: Column, spans: Column) -> Column:
    """A text without the words of its ``hit_spans``, what stands between the words of a span included; null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, hits in zip(texts, found, strict=True):
            if t is None or hits is None or not len(hits):
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            words = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD_BYTES))]
            kept, at = [], 0
            for h in hits:
                kept.append(raw[at : words[h["start"]][0]])
                at = words[h["end"] - 1][1]
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype="object")

    return of(text, spans)


def cut_long_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", longest: int = WINDOW, share: int = SHARE, **names: str
) -> DataFrame:
    """Documents with the spans cut out that are longer than ``longest`` words or of documents over the coverage limit.

    The other way to treat contamination: nothing is dropped, ``text_col`` loses the spans.
    Returns the columns of ``docs``. Defined cases: as :func:`benchmark_overlap`; a text of
    which all words are hit keeps what is not a word.
    """
    inner, _, restored = shield(docs)
    columns = [f"in_{i}" for i in range(len(docs.columns))]
    text = columns[docs.columns.index(text_col)]
    judged = benchmark_overlap(inner, benchmark, id_col=columns[0], text_col=text, share=share, **names)
    over = F.filter("hit_spans", lambda s: F.col("contaminated") | (s["end"] - s["start"] > longest))
    return judged.withColumn(text, without_hits(F.col(text), over)).select(*restored)
