"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.llm.common import arrow_batches, release_memory, shield, small

#: Characters in an n-gram.
ORDER = 5
#: One trusted document in this many sets thresholds instead of being learned from.
HELD_OUT = 4
#: Share of the held-out trusted documents of a language that pass.
QUANTILE = 0.995
#: Steps of log perplexity in which quantiles are taken.
STEPS = 1000
#: Texts are judged as if this many more characters of average trusted text stood in them, else a few letters decide on short ones.
PRIOR = 40
#: Bytes of text, about, that ask for their n-grams' probabilities together.
BUCKET_BYTES = 32_000_000
#: Rows of a table of the model (some 100 bytes each) that may be broadcast; larger ones meet the n-grams in a shuffle.
TABLE_ROWS = 300_000
#: Most buckets whose questions for one n-gram are one row.
TOGETHER = 1000
#: Characters coded at once.
CHUNK = 500_000
#: What stands before a text; no character of a text.
BEGIN = chr(0x10FFFF)
#: Rows that a Python worker gets at once, and n-grams that it counts before it passes them on.
ROWS, COUNTED = 2000, 500_000


# N-grams of characters


def _spelled(points: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    joined = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i : i + points.shape[1]] for i in range(0, len(joined), points.shape[1])]


def _distinct(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of codes of so many bits, and the number of each code among them."""
    low = max(1, (len(code) - 1).bit_length())
    if bits + low > 64:
        return np.unique(code, return_inverse=True)
    # Sorting codes with their places behind them is several times as fast as sorting places by code.
    both = code << np.uint64(low) | np.arange(len(code), dtype=np.uint64)
    both.sort()
    ranked = both >> np.uint64(low)
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    number = np.empty(len(code), np.int64)
    number[(both & np.uint64((1 << low) - 1)).astype(np.int64)] = np.cumsum(first) - 1
    return ranked[first], number


def _coded(pieces: list[str], owners: list[int]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """For each n-gram the text it is of and its number among the distinct ones, and those; pieces begin with ``ORDER - 1`` characters of context.

    The characters of the pieces are numbered, so an n-gram is one integer. Pieces of too many
    different characters for that are coded in halves.
    """
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = np.flatnonzero(np.bincount(points)).astype(np.uint32)
    bits = max(1, (len(alphabet) - 1).bit_length())
    if bits * ORDER > 64:
        if len(pieces) > 1:
            half = len(pieces) // 2
            yield from _coded(pieces[:half], owners[:half])
            yield from _coded(pieces[half:], owners[half:])
        else:
            half = len(pieces[0]) // 2
            yield from _coded([pieces[0][:half], pieces[0][half - ORDER + 1 :]], owners * 2)
        return
    table = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    table[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    s = table[points]
    code = s.copy()
    for back in range(1, ORDER):
        code[back:] |= s[:-back] << np.uint64(bits * back)
    lengths = np.array([len(x) for x in pieces])
    real = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= ORDER - 1  # the first ones are only context
    distinct, number = _distinct(code[real], bits * ORDER)
    places = np.uint64(bits) * np.arange(ORDER - 1, -1, -1, dtype=np.uint64)
    symbols = (distinct[:, None] >> places) & np.uint64((1 << bits) - 1)
    yield np.repeat(np.array(owners), lengths)[real], _spelled(alphabet[symbols.astype(np.int64)]), number


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """:func:`_coded` over whole texts, ``CHUNK`` characters, of one text or several, at a time."""
    pieces: list[str] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            before = text[max(0, at - ORDER + 1) : at]
            pieces.append(BEGIN * (ORDER - 1 - len(before)) + before + text[at : at + CHUNK])
            owners.append(i)
            size += len(pieces[-1])
            if size >= CHUNK:
                yield from _coded(pieces, owners)
                pieces, owners, size = [], [], 0
    if pieces:
        yield from _coded(pieces, owners)


# The model


@dataclass(frozen=True)
class NGramTables:
    """The model as tables sharded by n-gram, of any size.

    ``shares[k]``: ``gram, share``, the discounted share of each n-gram of k characters in its
    context; ``weights[k]``: ``context, weight``, what a context leaves to the shorter n-gram;
    ``floor``: what the empty context leaves to each single character, seen or not.
    """

    shares: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    floor: float


def fit(trusted: DataFrame, text_col: str = "text") -> NGramTables:
    """Fit the model on all trusted texts.

    Counts of n-grams are sharded by n-gram; lower orders count the distinct characters before
    an n-gram; context sums are joined back to the n-grams; discounts come from the counts of
    counts of each order. Only these few numbers reach the driver. Characters that do not
    occur share the room of one that does.
    """
    arrow_batches(trusted.sparkSession, ROWS)

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for pdf in parts:
            for _, grams, number in ngrams([t for t in pdf["text"] if t]):
                for gram, n in zip(grams, np.bincount(number, minlength=len(grams)).tolist(), strict=True):
                    held[gram] = held.get(gram, 0) + n
                if len(held) > COUNTED:
                    yield pd.DataFrame({"gram": list(held), "n": list(held.values())})
                    held = {}
        if held:
            yield pd.DataFrame({"gram": list(held), "n": list(held.values())})
        release_memory()

    counted = trusted.select(F.col(text_col).alias("text")).mapInPandas(tally, "gram string, n long")
    table = cut(counted.groupBy("gram").agg(F.sum("n").alias("n")))
    shares, weights, floor = {}, {}, 1.0
    for order in range(ORDER, 0, -1):
        ones = table.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("all")).first()
        n1, n2, n3, n4 = (max(x, 1) for x in ones[:4])  # counts that do not occur would leave a discount undefined
        y = n1 / (n1 + 2 * n2)
        discounts = [min(max(k - (k + 1) * y * b / a, 0.1), k - 0.1) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])
        keyed = table.withColumn("context", F.substring("gram", 1, order - 1)).withColumn("off", discount)
        sums = cut(keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("freed")))
        shares[order] = cut(keyed.join(sums, "context").select("gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("share")))
        weights[order] = sums.select("context", (F.col("freed") / F.col("total")).alias("weight"))
        if order == 1:
            whole = weights[1].first()
            floor = (whole.weight if whole else 1.0) / (ones["all"] + 1)
        else:
            table = cut(table.groupBy(F.substring("gram", 2, order - 1).alias("gram")).agg(F.count("*").alias("n")))
    return NGramTables(shares, weights, floor)


def probabilities(asked: DataFrame, model: NGramTables) -> DataFrame:
    """``asked`` (``gram`` and other columns) with ``log_p``: the log probability of the last character after the others.

    Count joins for each order, the longest first: the n-gram meets its share, and its context
    the weight with which the next shorter n-gram comes in. Tables counted to be small are
    broadcast, and the longest n-grams are met as they lie, so that few joins shuffle ``asked``.
    """
    others = asked.columns
    met = asked.withColumns({"p": F.lit(0.0), "room": F.lit(1.0)})
    for order in range(ORDER, 0, -1):
        tail = F.substring("gram", ORDER - order + 1, order) if order < ORDER else F.col("gram")
        met = met.withColumn("tail", tail).join(small(model.shares[order].withColumnRenamed("gram", "tail"), TABLE_ROWS), "tail", "left")
        met = met.withColumn("p", F.col("p") + F.col("room") * F.coalesce("share", F.lit(0.0)))
        if order > 1:
            met = met.withColumn("context", F.substring("tail", 1, order - 1)).join(small(model.weights[order], TABLE_ROWS), "context", "left")
            met = met.withColumn("room", F.col("room") * F.coalesce("weight", F.lit(1.0)))
        met = met.select(*others, "p", "room")
    return met.select(*others, F.log(F.col("p") + F.col("room") * F.lit(model.floor)).cast("float").alias("log_p"))


def scores(docs: DataFrame, model: NGramTables) -> DataFrame:
    """``id, text_hash, log_p, length`` of distinct ``id, text``: log probability of the whole text, and its characters.

    Rows are dealt to buckets of about ``BUCKET_BYTES`` by a hash, texts compressed on the
    way. Each bucket asks once for each distinct n-gram that its texts have; the n-grams, one
    row for up to ``TOGETHER`` buckets, meet the model in :func:`probabilities`, go back to
    the buckets that asked, and are summed over the texts there. What is shuffled beside the texts grows with the number of buckets, and
    nothing but batches of texts and one bucket's n-grams is in a worker at once.
    """
    spark = docs.sparkSession
    arrow_batches(spark, ROWS)
    docs = docs.filter("text is not null and text <> ''")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pd.Series([squeeze(t.encode("utf-8", "surrogatepass")) for t in texts])

    def unpacked(parts: pd.Series) -> list[str]:
        expand = zstandard.ZstdDecompressor().decompress
        return [expand(p).decode("utf-8", "surrogatepass") for p in parts]

    dealt = (
        docs.select("id", F.xxhash64("text").alias("text_hash"), packed("text").alias("packed"), F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int").alias("bucket"))
        .repartition("bucket")
        .sortWithinPartitions("bucket")
    )

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = -1, set()
        for pdf in parts:
            for bucket, mine in pdf.groupby("bucket"):
                if bucket != at:
                    at, seen = bucket, set()
                for _, grams, _ in ngrams(unpacked(mine["packed"])):
                    new = [g for g in grams if g not in seen]
                    seen.update(new)
                    yield pd.DataFrame({"bucket": bucket, "gram": new})
        release_memory()

    # All columns go to the function: the two uses of the dealt texts then share one shuffle.
    asked = dealt.mapInPandas(ask, "bucket int, gram string")
    # Rows are spread by n-gram first: lists begun in the tasks that ask would hold one bucket each, and take memory there.
    together = asked.repartition("gram").groupBy("gram", F.floor(F.col("bucket") / TOGETHER).alias("span")).agg(F.collect_list("bucket").alias("buckets"))
    told = probabilities(together.select("gram", "buckets"), model).select(F.explode("buckets").alias("bucket"), "gram", "log_p")

    def add_up(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(told["gram"], told["log_p"], strict=True))
        out = texts[["id", "text_hash"]].assign(log_p=0.0, length=0)
        total, length = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for first in range(0, len(texts), ROWS):
            here = unpacked(texts["packed"].iloc[first : first + ROWS])
            length[first : first + ROWS] = [len(t) for t in here]
            for owner, grams, number in ngrams(here):
                values = np.fromiter((of[g] for g in grams), np.float64, len(grams))
                total[first : first + len(here)] += np.bincount(owner, values[number], len(here))
        release_memory()
        return out.assign(log_p=total, length=length)

    kind = docs.schema["id"].dataType.simpleString()
    summed = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(add_up, f"id {kind}, text_hash long, log_p double, length long")
    return cut(summed.dropDuplicates(["id", "text_hash"]))


# Verdicts


def quality_verdicts(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
) -> DataFrame:
    """Accept documents that read like trusted ones of their language.

    Trusted documents are those that ``labels`` (``doc_id, quality, toxic``) names with
    quality 1 and toxic 0. The model is fitted on three in ``HELD_OUT`` of them, by a hash of
    the ids; a language's threshold is the ``quantile`` of the scores of the others, taken from
    counts by thousandths of log perplexity, so that reruns agree. A score is the perplexity
    drawn to the mean of the trusted texts by ``PRIOR`` characters. Languages without held-out
    trusted documents take the threshold of all of them. Ids of trusted documents are
    broadcast only if they are counted to be few.

    Returns the columns of ``df`` (those that clash with the new names give way) and
    ``perplexity`` (plain), ``score``, ``threshold`` double, ``accepted`` boolean. Defined
    cases: null and empty texts have a null perplexity and are rejected; a null language is one
    of its own; without held-out trusted text the thresholds are null and all texts with a
    character are accepted; repeated labels do no harm; repeated rows are judged alike; empty
    input gives no rows.
    """
    _, _, restored = shield(df)
    judged = _judged(df, labels, id_col, text_col, lang_col, quantile)
    new = ["perplexity", "score", "threshold", "accepted"]
    return judged.select(*[c for c, n in zip(restored, df.columns, strict=True) if n not in new], *new)


def _judged(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float) -> DataFrame:
    """Shielded columns, ``key_hash`` (of the text) and the verdict of every row."""
    inner, col, _ = shield(df)
    doc, text = col(id_col), col(text_col)
    named = labels.filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("trusted_id")).dropna().distinct()
    named = named.withColumn("apart", F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT)) == 0)
    trusted = inner.join(small(named.filter("not apart")), doc == F.col("trusted_id"), "left_semi")
    scored = scores(inner.select(doc.alias("id"), text.alias("text")), fit(trusted.select(text.alias("text"))))

    lang = F.concat(F.when(col(lang_col).isNull(), "n").otherwise("s"), F.coalesce(col(lang_col), F.lit("")))
    keyed = inner.withColumns({"lang_key": lang, "key_hash": F.xxhash64(text)})
    same = lambda scored: doc.eqNullSafe(scored["id"]) & (F.col("key_hash") == scored["text_hash"])
    known = scored.join(small(named.filter("apart")), scored["id"] == F.col("trusted_id"), "left_semi")
    held_out = cut(keyed.select(doc, "lang_key", "key_hash").join(known, same(known)).select("lang_key", "log_p", "length"))
    mean = held_out.agg(F.sum("log_p") / F.sum("length")).first()[0] or 0.0
    drawn = lambda: F.exp(-(F.col("log_p") + F.lit(PRIOR * mean)) / (F.col("length") + PRIOR))
    seen = held_out.groupBy("lang_key", F.ceil(F.log(drawn()) * STEPS).alias("step")).agg(F.count("*").alias("n"))
    every = seen.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang_key"), "step", "n")
    by_step = Window.partitionBy("lang_key").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    limits = cut(
        seen.unionByName(every)
        .withColumn("below", F.sum("n").over(by_step))
        .withColumn("all", F.sum("n").over(Window.partitionBy("lang_key")))
        .filter(F.col("below") >= F.col("all") * quantile)
        .groupBy("lang_key")
        .agg(F.exp(F.min("step") / STEPS).alias("limit"))
    )
    overall = limits.filter("lang_key = ''").select("limit").first()
    judged = (
        keyed.join(scored, same(scored), "left")
        .join(small(limits.filter("lang_key <> ''")), "lang_key", "left")
        .withColumns({"perplexity": F.exp(-F.col("log_p") / F.col("length")), "score": drawn()})
        .withColumn("threshold", F.coalesce("limit", F.lit(overall.limit if overall else None).cast("double")))
    )
    accepted = F.col("score").isNotNull() & (F.col("threshold").isNull() | (F.col("score") <= F.col("threshold")))
    return judged.withColumn("accepted", accepted)


def keep_accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The accepted documents of :func:`quality_verdicts`, with their own columns.

    Rejected ids and text hashes, the fewer, are taken out, broadcast only if counted to be
    few, so that texts are not shuffled for it. Defined cases: as there; columns of any name
    stay as they are; rows that repeat id and text stay or go together if their language is
    the same, and go together otherwise.
    """
    inner, col, restored = shield(df)
    judged = _judged(df, labels, id_col, text_col, lang_col, QUANTILE)
    gone = judged.filter("not accepted and score is not null").select(col(id_col).alias("id"), F.col("key_hash").alias("text_hash"))
    gone = small(cut(gone.distinct()))
    there = inner.filter(col(text_col).isNotNull() & (col(text_col) != ""))
    return there.join(gone, col(id_col).eqNullSafe(gone["id"]) & (F.xxhash64(col(text_col)) == gone["text_hash"]), "left_anti").select(*restored)
