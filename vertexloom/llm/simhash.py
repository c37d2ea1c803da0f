"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.analytics.components import connected_components
from vertexloom.lineage import cut
from vertexloom.llm.common import arrow_batches, release_memory, shield, small

#: Seed of the shingle hash.
SEED = 42
#: Fingerprints of one routing key that are indexed together; keys with more are routed further.
KEY_ROWS = 1024
#: Shingles whose bits are counted at once.
VOTE_ROWS = 100_000
#: Codes under one index node.
FANOUT = 8
#: Most series of codes that are searched together; also keeps the key paths of all levels apart.
SERIES = 256
#: Bits of each of the four blocks at the successive routing levels; with all of them a key has 2 ** 15 codes at most.
BLOCK_BITS = (16, 12, 9, 7, 5)
#: Documents, about, in which frequent shingles are sought, in how many of them a shingle must occur, and most of them.
#: They only order the shingles, so that few texts meet under each; the pairs found do not depend on them.
HOT_SAMPLE, HOT_COUNT, HOT_SHINGLES = 5000, 4, 100_000
#: Rows of one shingle that wait in a worker for one of another group.
HELD_ROWS = 20_000
#: The pairs of the texts under a shingle are dealt to ``SALTS`` tasks if they are more than this.
SALT_ROWS, SALTS = 2000, 16
#: Times that the texts under a shingle are first compared with one of them.
STARS = 2
#: Rows of numbers, and rows with texts, that a Python worker gets at once.
NUMBER_ROWS, TEXT_ROWS = 10_000, 500


# Fingerprints


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (all words, if fewer), A-Z lower-cased; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash_of(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - size + 1
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One code for each run of ``counts`` hashes: a bit is 1 if set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):
        begin = ends[first] - counts[first]
        last = max(int(np.searchsorted(ends, begin + VOTE_ROWS, "right")), first + 1)
        votes = np.zeros((last - first, 64), np.int64)
        for at in range(int(begin), int(ends[last - 1]), VOTE_ROWS):  # a single long text is counted in parts
            part = hashes[at : min(at + VOTE_ROWS, int(ends[last - 1]))]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            owner = np.searchsorted(ends[first:last], np.arange(at, at + len(part)), "right")
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            votes[owner[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        set_bits = (2 * votes > counts[first:last, None]).astype(np.uint8)
        out[first:last] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
        first = last
    return out


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """SimHash of the word shingles of ``text`` (repeats count), as a signed long; no words: 0."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            hashes = [shingle_hashes(t, shingle) for t in texts]
            counts = np.array([len(h) for h in hashes], np.int64)
            yield pd.Series(majority(np.concatenate(hashes), counts).view(np.int64) if hashes else np.empty(0, np.int64))
        release_memory()

    return of(text)


# The index


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _upper_nodes(masks: np.ndarray, patterns: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes over the runs that begin at ``heads``: the bits that all below share, and their values."""
    ones = np.bitwise_and.reduceat(patterns | ~masks, heads)
    zeros = np.bitwise_and.reduceat(~patterns | ~masks, heads)
    known = np.bitwise_and.reduceat(masks, heads)
    mask = (ones | zeros) & known
    return mask, ones & mask


class GrayIndex:
    """Runs of codes in Gray order, each under levels of nodes that hold the bits all their codes share.

    Two nodes can only hold codes within ``d`` bits if their shared bits differ in at most
    ``d`` places, so pairs of nodes are followed downwards from the roots, and whole pairs are
    dropped, or, if even their free bits cannot exceed ``d``, taken as a whole. A run has one
    root; the searches of all runs go on together.
    """

    def __init__(self, codes: np.ndarray, heads: np.ndarray):
        """``codes``: the runs one after another; ``heads``: where each begins."""
        self.codes = codes
        masks, patterns, begins = np.full(len(codes), ~np.uint64(0)), codes, np.arange(len(codes) + 1)
        #: From the codes to the roots: shared bits, their values, first codes and first nodes below.
        self.levels = [(masks, patterns, begins, begins)]
        while len(patterns) > len(heads):
            sizes = np.diff(np.append(heads, len(patterns)))
            firsts = np.flatnonzero((np.arange(len(patterns)) - np.repeat(heads, sizes)) % FANOUT == 0)
            masks, patterns = _upper_nodes(masks, patterns, firsts)
            below = np.append(firsts, begins.size - 1)
            begins, heads = begins[below], np.searchsorted(firsts, heads)
            self.levels.append((masks, patterns, begins, below))

    def links(self, distance: int) -> np.ndarray:
        """Pairs of positions that join exactly those codes of a run that chains of steps of at most ``distance`` bits join."""
        parent = list(range(len(self.codes)))
        out = []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        def join(i: int, j: int) -> None:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))

        roots = np.arange(len(self.levels[-1][1]))
        stack = [(len(self.levels) - 1, roots, roots)]
        while stack:
            level, left, right = stack.pop()
            masks, patterns, begins, below = self.levels[level]
            both = masks[left] & masks[right]
            apart = _popcount((patterns[left] ^ patterns[right]) & both)
            keep = (apart <= distance) & ((left != right) | (begins[left + 1] - begins[left] > 1))
            left, right, both, apart = left[keep], right[keep], both[keep], apart[keep]
            whole = apart + _popcount(~both) <= distance
            for i, j in zip(left[whole].tolist(), right[whole].tolist(), strict=True):
                for k in (*range(begins[i], begins[i + 1]), *range(begins[j], begins[j + 1])):
                    join(int(begins[i]), k)
            left, right = left[~whole], right[~whole]
            step = np.arange(FANOUT)
            for at in range(0, len(left) if level else 0, 4096):
                i, j = left[at : at + 4096], right[at : at + 4096]
                a, b = below[i][:, None] + step, below[j][:, None] + step
                ok = (a < below[i + 1][:, None])[:, :, None] & (b < below[j + 1][:, None])[:, None, :] & (a[:, :, None] <= b[:, None, :])
                x, y, z = np.nonzero(ok)
                stack.append((level - 1, a[x, y], b[x, z]))
        return np.array(out, np.int64).reshape(-1, 2)


def _gray_rank(code: Column) -> Column:
    """Position of a code in the reflected Gray order (its unsigned bits; the sign only turns the order)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _routes(level: int) -> Column:
    """The four (path, value) keys of a code at a routing level, beside those of the levels above.

    Level 0 cuts the 64 bits into four blocks of 16. Codes within three bits agree in one
    block at least, and that block is then left out: the other 48 bits are cut into four of
    12 at level 1, and the 36 that remain then into four of 9 at level 2, where the same holds.
    """
    bits = BLOCK_BITS[level]
    cut_at = lambda rest, i: F.shiftrightunsigned(rest, i * bits).bitwiseAND(F.lit((1 << bits) - 1))
    return F.array(
        *[
            F.struct(
                (F.col("path") * 4 + i).cast("int").alias("path"),
                F.shiftleft(F.col("value"), bits).bitwiseOR(cut_at(F.col("rest"), i)).alias("value"),
                # What remains: the block's bits are taken out and the higher ones move down.
                F.col("rest").bitwiseAND(F.lit((1 << (i * bits)) - 1)).bitwiseOR(
                    F.shiftleft(F.shiftrightunsigned(F.col("rest"), min((i + 1) * bits, 63)) if (i + 1) * bits < 64 else F.lit(0).cast("long"), i * bits)
                ).alias("rest"),
            )
            for i in range(4)
        ]
    )


def _routed(codes: DataFrame) -> DataFrame:
    """``code`` under each routing key; keys with many codes are cut further, level by level."""
    rows = codes.select("series", "code", (F.lit(SERIES) + F.col("series")).cast("int").alias("path"), F.lit(0).cast("long").alias("value"), F.col("code").alias("rest"))
    done = None
    for level in range(len(BLOCK_BITS)):
        rows = rows.select("series", "code", F.explode(_routes(level)).alias("r")).select("series", "code", "r.*")
        if level + 1 == len(BLOCK_BITS):
            break
        full = cut(rows.groupBy("path", "value").count().filter(F.col("count") > KEY_ROWS).select("path", "value"))
        if full.isEmpty():
            break
        calm = rows.join(full, ["path", "value"], "left_anti").select("series", "code", "path", "value", "rest")
        done = calm if done is None else done.unionByName(calm)
        rows = rows.join(full, ["path", "value"], "left_semi").select("series", "code", "path", "value", "rest")
    return (rows if done is None else done.unionByName(rows)).select("series", "path", "value", "code")


def _links_of_runs(keys: np.ndarray, run: np.ndarray, distance: int) -> np.ndarray:
    """Links ``series, a, b`` inside the runs of one key; ``keys`` holds series, path and value, ``run`` Gray-ordered codes."""
    heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    pairs = GrayIndex(run.view(np.uint64), heads).links(distance)
    return np.column_stack([keys[pairs[:, 0], 0], run[pairs[:, 0]], run[pairs[:, 1]]])


def near_links(codes: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``series, a, b`` that join the codes of each series as all pairs within ``distance`` bits would.

    ``codes`` holds distinct pairs ``series`` (int below 256) and ``code`` (long). Codes meet
    under the keys of :func:`_routes` (four blocks find every pair of up to three differing
    bits), are sorted by Gray rank, and each key's run is searched through a
    :class:`GrayIndex`. A run gives at most one link fewer than it has codes, so dense groups
    do not give all their pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the routing covers distances from 0 to 3")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_keys, held = np.empty((0, 3), np.int64), np.empty(0, np.int64)
        for pdf in parts:
            if not len(pdf):
                continue
            keys = np.concatenate([held_keys, pdf[["series", "path", "value"]].to_numpy(np.int64)])
            run = np.concatenate([held, pdf["code"].to_numpy(np.int64)])
            whole = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            held_keys, held = keys[whole:], run[whole:]  # the last key may go on in the next batch
            if whole:
                yield pd.DataFrame(_links_of_runs(keys[:whole], run[:whole], distance), columns=["series", "a", "b"])
        if len(held):
            yield pd.DataFrame(_links_of_runs(held_keys, held, distance), columns=["series", "a", "b"])
        release_memory()

    return (
        _routed(codes)
        .repartition("path", "value")
        .sortWithinPartitions("path", "value", _gray_rank(F.col("code")))
        .mapInPandas(search, "series int, a long, b long")
        .distinct()
    )


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """Fingerprint and near-duplicate component of every row.

    Fingerprints are computed once, kept in the checkpoint folder and made distinct, so any
    number of copies is one code. Codes within ``distance`` bits are linked by
    :func:`near_links`, and components of linked codes get their smallest id.

    Returns ``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, a row
    for each row of ``df``.

    Defined cases: null and blank texts have fingerprint zero and are linked like others.
    Fewer words than a shingle make one shingle. Null ids are ignored when the smallest is
    sought; a component of null ids only has a null ``component_id``. Empty input gives no rows.
    """
    arrow_batches(df.sparkSession, TEXT_ROWS)
    inner, col, _ = shield(df)
    printed = cut(inner.select(col(id_col).alias("id"), fingerprint(col(text_col), shingle).alias("code")))
    arrow_batches(df.sparkSession, NUMBER_ROWS)
    classes = cut(printed.groupBy("code").agg(F.min("id").alias("least")))
    links = near_links(classes.select(F.lit(0).alias("series"), "code"), distance)
    parts = connected_components(links.select("a", "b"))
    rooted = classes.join(parts.withColumnRenamed("node", "code"), "code", "left").withColumn("component", F.coalesce("component", "code"))
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "component").select("code", "component_id")
    return printed.join(named, "code").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )


# Whole texts that are alike


def word_codes(text: Column, seeds: int) -> Column:
    """``seeds`` independent SimHash codes of the distinct words of a text; null for a text without words."""

    @F.pandas_udf("array<long>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            bases = [np.unique(shingle_hashes(t, 1)) for t in texts]
            counts = np.array([len(b) for b in bases], np.int64)
            some = counts > 0
            codes = np.zeros((len(bases), seeds), np.uint64)
            if some.any():
                every = np.concatenate(bases)
                for k in range(seeds):
                    x = every + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    codes[some, k] = majority(x ^ (x >> np.uint64(31)), counts[some])
            yield pd.Series([c if n else None for c, n in zip(codes.view(np.int64), some, strict=True)], dtype="object")
        release_memory()

    return of.asNondeterministic()(text)  # else the optimizer filters on its result first, which runs it twice


def shingle_set(text: Column, size: int) -> Column:
    """The distinct shingle hashes of a text, in order."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, size)).view(np.int64) for t in texts])

    return of.asNondeterministic()(text)


def _hot_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles that occur in several of a bounded sample of ``id, text``, sorted."""
    share = min(1.0, HOT_SAMPLE / max(texts.count(), 1))
    drawn = texts.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 50)) < int((1 << 50) * share))
    counted = drawn.select(F.explode(shingle_set(F.col("text"), size)).alias("key")).groupBy("key").count().filter(F.col("count") >= HOT_COUNT)
    rows = counted.orderBy(F.desc("count"), "key").limit(HOT_SHINGLES).collect()
    return np.sort(np.array([r.key for r in rows], np.int64))


def _prints(texts: DataFrame, size: int, similarity: float, hot: np.ndarray) -> DataFrame:
    """``id, n, same, sketch, folded, keys`` of ``id, text``: number of shingles, digest and parity sketch of their set, that folded to 256 bits, and its prefix.

    Shingles are ordered by hash, frequent ones last. Two sets of at least the wanted
    similarity share a shingle among the first ``n - ceil(similarity * n) + 1`` of each. Each
    shingle turns one bit of the sketch, which has one to two bits a shingle, a power of two, 256 at least.
    Texts without words are left out.
    """
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    @F.pandas_udf("struct<n:int,same:binary,sketch:binary,folded:array<long>,keys:array<long>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        last = sent.value
        for texts in parts:
            rows = []
            for t in texts:
                every = np.unique(shingle_hashes(t, size))
                n = len(every)
                size_here = 1 << max(8, (n - 1).bit_length())
                bits = np.bincount((every & np.uint64(size_here - 1)).astype(np.int64), minlength=size_here).astype(np.uint8) & 1
                keys = every.view(np.int64)
                late = last[np.minimum(np.searchsorted(last, keys), len(last) - 1)] == keys if len(last) else np.zeros(n, bool)
                keys = np.concatenate([keys[~late], keys[late]])[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                sketch = np.packbits(bits)
                short = np.bitwise_xor.reduce(sketch.reshape(-1, 32), axis=0).view(np.int64)
                rows.append((n, xxhash.xxh3_128_digest(every.tobytes()), sketch.tobytes(), short, keys))
            yield pd.DataFrame(rows, columns=["n", "same", "sketch", "folded", "keys"])
        release_memory()

    # The filter follows a checkpoint; without one it would run the function a second time.
    return cut(texts.select("id", of("text").alias("p")).select("id", "p.*")).filter("n > 0")


def bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two parity sketches differ, the longer one folded: never more than the sets differ in shingles."""

    def folded(x: np.ndarray, size: int) -> np.ndarray:
        while len(x) > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return x

    @F.pandas_udf("int")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(left, right, strict=True):
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            size = min(len(x), len(y))
            out.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))
        return pd.Series(out, dtype="int32")

    return of(a, b)


def _meetings(rows: DataFrame) -> DataFrame:
    """``key, id, n, pos, part`` of ``id, n, keys, part``: the shingles of prefixes that texts of several parts share.

    Texts meet under their shingles in one shuffle; most shingles are of one text and go.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def several(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, told = None, False  # rows of the last key, which may go on; whether it is known to have several parts
        for pdf in parts:
            every = pdf if held is None else pd.concat([held, pdf])
            if not len(every):
                continue
            key, part = every["key"].to_numpy(np.int64), pd.factorize(every["part"])[0]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            mixed = np.minimum.reduceat(part, heads) != np.maximum.reduceat(part, heads)
            mixed[0] |= told
            mixed[-1] |= len(key) - heads[-1] > HELD_ROWS  # too many to wait for another part
            keep = np.repeat(mixed, np.diff(np.append(heads, len(key))))
            if told:
                keep[0] = False  # passed on before; it only stands for its key
            if not mixed[-1]:
                keep[heads[-1] :] = False
            yield every[keep]
            told = bool(mixed[-1])
            held = every[-1:] if told else every[heads[-1] :]

    keyed = rows.select("id", "n", "part", F.posexplode("keys").alias("pos", "key")).repartition("key").sortWithinPartitions("key")
    return cut(keyed.select("key", "id", "n", "pos", "part").mapInPandas(several, f"key long, id {kind}, n int, pos int, part {kind}"))


def _apart(met: DataFrame) -> DataFrame:
    """Those of ``met`` under shingles with texts of several parts, with the number of ``texts`` there."""
    counted = met.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("texts"))
    return cut(met.join(counted.filter("least <> most").select("key", "texts"), "key"))


def _may_be_alike(similarity: float) -> Column:
    """Of two texts under a shingle: they share so many shingles, of which none come before the first one that they share."""
    least = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return (F.col("part_a") != F.col("part_b")) & (F.least("n_a", "n_b") >= least) & (room >= least)


def _star_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs ``a, b``: under each shingle the text of the least part with those of other parts, one pair a text."""
    first = met.groupBy("key").agg(F.min(F.struct("part", "id", "n", "pos")).alias("f")).select(
        "key", F.col("f.part").alias("part_a"), F.col("f.id").alias("id_a"), F.col("f.n").alias("n_a"), F.col("f.pos").alias("pos_a")
    )
    others = met.select("key", F.col("part").alias("part_b"), F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    return others.join(first, "key").filter(_may_be_alike(similarity)).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _most_apart(similarity: float) -> Column:
    """Shingles in which the sets of two alike texts can differ."""
    return F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-6


def _all_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs ``a, b`` of texts of two parts under a shingle; those of many texts are dealt to ``SALTS`` tasks.

    Pairs whose folded sketches differ too much are left out within the join.
    """
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos", "part", "folded")]
    salts = F.when(F.col("texts") > SALT_ROWS, SALTS).otherwise(1)
    left = met.select("key", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), *side("a"))
    right = met.select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *side("b"))
    apart = F.lit(0)
    for i in range(4):
        apart = apart + F.bit_count(F.col("folded_a")[i].bitwiseXOR(F.col("folded_b")[i]))
    same = [left["key"] == right["key"], left["salt"] == right["salt"]]
    pairs = left.join(right, [*same, F.col("id_a") < F.col("id_b"), _may_be_alike(similarity), apart <= _most_apart(similarity)])
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _like_sketches(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose parity sketches differ no more than those of alike texts can."""
    sketches = rows.select("id", "n", "sketch")
    both = pairs.join(sketches.toDF("a", "n_a", "sketch_a"), "a").join(sketches.toDF("b", "n_b", "sketch_b"), "b")
    return both.filter(bits_apart(F.col("sketch_a"), F.col("sketch_b")) <= _most_apart(similarity)).select("a", "b")


def drop_near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    seeds: int = 4,
) -> DataFrame:
    """Keep one row, that with the smallest id, of each group of rows with alike texts.

    Texts are alike if the Jaccard similarity of their sets of ``shingle``-word shingles is
    at least ``similarity``. A first pass takes candidates from ``seeds`` independent 64-bit
    SimHash codes of the distinct words, each searched at three bits by :func:`near_links`;
    within a code, texts are compared with the smallest id, and linked codes through theirs.
    It joins most copies cheaply but misses pairs, such as those with an added block. A second
    pass is exact: texts of different groups that share a shingle of their prefixes
    (:func:`_prints`) are compared, first with one text under each shingle, which joins large
    groups without their pairs, then all those whose groups are still apart. Every candidate
    is confirmed on whole texts, so nothing is dropped for its fingerprint alone and no alike
    pair is left.

    Returns the columns of ``df``. Defined cases: rows without words and rows with a null id
    stay; equal ids are one row's repeats and all stay; empty input gives no rows.
    """
    spark = df.sparkSession
    arrow_batches(spark, TEXT_ROWS)
    inner, col, restored = shield(df)
    doc, text = col(id_col), col(text_col)
    coded = cut(
        inner.filter(doc.isNotNull())
        .select(doc.alias("id"), word_codes(text, seeds).alias("codes"))
        .select("id", F.posexplode("codes").alias("series", "code"))
    )
    arrow_batches(spark, NUMBER_ROWS)
    classes = cut(coded.groupBy("series", "code").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    leader = classes.select("series", "code", "least")
    members = coded.join(classes.filter("n > 1").select("series", "code", "least"), ["series", "code"])
    linked = (
        near_links(classes.select("series", "code"))
        .join(leader.toDF("series", "a", "least_a"), ["series", "a"])
        .join(leader.toDF("series", "b", "least_b"), ["series", "b"])
    )
    pairs = members.select(F.col("least").alias("a"), F.col("id").alias("b")).unionByName(
        linked.select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    )
    pairs = cut(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def alike(pairs: DataFrame) -> DataFrame:
        arrow_batches(spark, TEXT_ROWS)
        named = small(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        sets = cut(
            inner.withColumn("id", doc).join(named, "id", "left_semi").select("id", shingle_set(text, shingle).alias("shingles")).dropDuplicates(["id"])
        )
        common = F.size(F.array_intersect("sa", "sb"))
        return cut(
            pairs.join(sets.toDF("a", "sa"), "a")
            .join(sets.toDF("b", "sb"), "b")
            .filter(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common))
            .select("a", "b")
        )

    first = alike(pairs)
    texts = inner.filter(doc.isNotNull()).select(doc.alias("id"), text.alias("text"))
    prints = _prints(texts, shingle, similarity, _hot_shingles(texts, shingle))
    arrow_batches(spark, NUMBER_ROWS)
    # Equal sets are one: the others are linked to that of the smallest id and left out of the search.
    least = prints.groupBy("same").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("same", "a")
    equal = cut(prints.select("same", F.col("id").alias("b")).join(least, "same").filter("a <> b").select("a", "b").distinct())
    rows = prints.join(small(equal.select(F.col("b").alias("id"))), "id", "left_anti")
    parts = cut(connected_components(first.unionByName(equal)).toDF("id", "component"))

    def in_parts(texts: DataFrame) -> DataFrame:
        return texts.join(small(parts), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")

    met = _apart(_meetings(in_parts(rows)))
    before = None
    for search in (*[_star_pairs] * STARS, _all_pairs):
        if search is before:
            continue  # nothing was linked by it, so it would find the same pairs
        if search is _all_pairs:
            met = met.join(rows.select("id", "folded"), "id")
        found = alike(cut(_like_sketches(cut(search(met, similarity)), rows, similarity)))
        arrow_batches(spark, NUMBER_ROWS)
        before = search
        if not found.isEmpty():
            before = None
            parts = cut(connected_components(parts.toDF("a", "b").unionByName(found)).toDF("id", "component"))
            if search is not _all_pairs:
                met = _apart(in_parts(met.drop("part", "texts")))
    gone = small(parts.filter("id <> component").select("id"))
    return inner.withColumn("id", doc).join(gone, "id", "left_anti").select(*restored)
