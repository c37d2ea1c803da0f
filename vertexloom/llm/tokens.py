"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import arrow_batches, shield

TOKEN_LIMIT = 1024
#: Pre-tokens whose counts a worker keeps; beyond that it begins anew. Those of over 64 characters are not kept.
KEPT = 300_000
#: Bytes of pre-tokens merged at once (a longer single one is merged alone).
MERGE_BYTES = 1 << 20
#: Fixed: how byte-level BPE cuts text before its merges, with the Unicode property for white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 is itself, the others follow from code point 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class RankMerger:
    """Counts what is left of byte sequences after the merges of a byte-level BPE vocabulary."""

    def __init__(self, spec: dict):
        vocabulary = spec["model"]["vocab"]
        self.byte_ids = np.array([vocabulary[c] for c in _byte_symbols()], np.int64)
        self.width = len(vocabulary)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        #: Strings that the library takes out of a text whole, before it is cut.
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges for pairs that do not merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence.

        All sequences lie in one array. In every round each finds its lowest-ranked pair, and
        all places of that pair are merged at once, from the left where they overlap. That is
        the order of the library: a pair made by a merge never ranks before the merge itself.
        Sequences without a pair left drop out of the array.
        """
        sizes = np.array([len(s) for s in sequences], np.int64)
        out = sizes.copy()
        owner = np.repeat(np.arange(len(sequences)), sizes)
        symbols = self.byte_ids[np.frombuffer(b"".join(sequences), np.uint8)]
        none = len(self.keys)
        rank = np.where(owner[1:] == owner[:-1], self._rank(symbols[:-1], symbols[1:]), none) if len(symbols) else np.empty(0, np.int64)
        rank = np.append(rank, none) if len(symbols) else rank
        while len(symbols):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(heads, len(symbols)))
            best = np.minimum.reduceat(rank, heads)
            live = best < none
            if not live.all():
                out[owner[heads[~live]]] = sizes[~live]
                keep = np.repeat(live, sizes)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                if not len(symbols):
                    break
                sizes, best = sizes[live], best[live]
            chosen = (rank == np.repeat(best, sizes)) & (rank < none)
            at = np.flatnonzero(chosen)
            begins = np.append(True, np.diff(at) != 1)  # of overlapping places every other one
            run = np.flatnonzero(begins)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            now = place[at]
            touched = np.unique(np.concatenate([now[now > 0] - 1, now]))
            right = np.minimum(touched + 1, len(symbols) - 1)
            same = (touched + 1 < len(symbols)) & (owner[right] == owner[touched])
            rank[touched] = np.where(same, self._rank(symbols[touched], symbols[right]), none)
        return out


class TokenCounter:
    """Counts tokens of texts; keeps the counts of a bounded number of pre-tokens."""

    def __init__(self, spec: dict):
        self.merger = RankMerger(spec)
        self.cut = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, self.merger.specials))) if self.merger.specials else None
        self.known: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        batch, size = [], 0
        for i, token in enumerate(new):
            batch.append(token)
            size += len(token)
            if size >= MERGE_BYTES or i + 1 == len(new):
                for t, n in zip(batch, self.merger.counts([t.encode("utf-8", "surrogatepass") for t in batch]).tolist(), strict=True):
                    self.known[t] = n
                batch, size = [], 0

    def count(self, texts: list[str]) -> list[int]:
        pieces, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            pieces.append([t for part in parts for t in self.cut(part)] if len(parts) > 1 else self.cut(text))
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        new = {t for tokens in pieces for t in tokens if t not in known}
        if new:
            self._learn(list(new))
        get = known.__getitem__
        counts = [sum(map(get, tokens)) + n for tokens, n in zip(pieces, extra, strict=True)]
        for token in new:
            if len(token) > 64:
                del known[token]
        return counts


@lru_cache(maxsize=2)
def _counter(name: str) -> TokenCounter:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return TokenCounter(json.load(f))


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes and tokens of every text under a byte-level BPE vocabulary.

    Args:
        vocabulary: path of the vocabulary's .json file on the driver; it is sent to the
            executors as a file, once each.

    Texts are cut into pre-tokens, a batch at a time; new ones are merged together as ragged
    arrays (:class:`RankMerger`), and a worker keeps a bounded number of counts. Special
    strings inside texts count as one token each; none are added.

    Returns the columns of ``df`` (those that clash with the new names give way) and
    ``n_bytes, n_tokens`` long, ``over_limit`` boolean. Defined cases: null and empty texts
    have zero bytes and tokens; repeated rows are counted each; empty input gives no rows.
    """
    spark = df.sparkSession
    arrow_batches(spark, rows=1000, megabytes=4)
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(name)
        for texts in parts:
            yield pd.Series(counter.count(["" if t is None else t for t in texts]), dtype="int64")

    inner, col, restored = shield(df)
    counted = inner.withColumn("n_tokens", count(col(text_col)))
    new = ["n_bytes", "n_tokens", "over_limit"]
    return counted.select(
        *[c for c, n in zip(restored, df.columns, strict=True) if n not in new],
        F.octet_length(F.coalesce(col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
    )
