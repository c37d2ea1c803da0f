"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.llm.common import shield

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Words that the mix takes, as a share of all words there are.
SHARE = 1.5
#: A source's target and a document's words are taken this many times at most.
REPEATS = 2
#: Weight over time, as (time, weight) points with straight lines between, for the sources in turn: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Leading hex digits of the order hash that make a bucket: each source is dealt over 4096.
BUCKET_DIGITS = 3


def demand_time(schedule: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time by which a source has met ``share`` of its demand: the inverse of its integrated weight."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    total = sum(areas)
    if total <= 0 or min(areas) < 0:
        raise ValueError("a schedule needs rising times and a positive integral")
    out, done = None, total
    for k in reversed(range(len(areas))):
        (t0, w0), (t1, w1) = schedule[k], schedule[k + 1]
        done -= areas[k]
        due = share * F.lit(total) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        if slope:
            within = (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * due, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        else:
            within = due / F.lit(w0) if w0 else F.lit(0.0)
        at = F.lit(t0) + within
        out = at if out is None else F.when(share * F.lit(total) < F.lit(done + areas[k]), at).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Add ``rank, weight, target`` to ``source, source_size``, a row a source.

    Targets are ``level * weight``, but at most ``repeats`` times the source's size. The level
    that shares out everything is the largest, over k, of what is left for the sources beyond
    the k that fill up first, divided by their weights.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    beyond = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_rank = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(of_rank, (F.col("rank") % len(weights)).cast("int") + 1))
        .withColumn("room", F.col("source_size") * repeats)
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("left", F.col("all_size") * F.lit(float(share)) - F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("level", F.max(F.col("left") / F.sum("weight").over(beyond)).over(everything))
        .withColumn("target", F.least(F.col("room").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "rank", "weight", "target")
    )


def mixing_plan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """What a mix takes of every row.

    The rows of a source stand in the order of a hash of their ids; the source's target is
    filled from that order, and from its start again up to ``repeats`` times. Running sums go
    by (source, bucket of the hash) and the buckets' sums by source, so a source of any size
    is dealt out. A row's position in a pass is the time at which the source's demand, the
    integral of its schedule, reaches the row's place in the order, whole passes before it
    counted.

    Returns the columns of ``df`` (those that clash with the new names give way) and ``size``
    (words), ``source_size, target`` (its source's), ``taken`` (words, repeats counted),
    ``taken_by_pass`` (array, a pass each), ``positions`` (array, 0 to 1, null for a pass that
    takes nothing).

    Defined cases: null texts have no words; a null source is a source, the last; rows that
    repeat an id stand together, smaller ones first; a source without words has target zero;
    if the mix asks for more than all there is, every row is taken ``repeats`` times. Empty
    input gives no rows.
    """
    inner, col, restored = shield(df)
    name = F.concat(F.when(col(source_col).isNull(), "n").otherwise("s"), F.coalesce(col(source_col), F.lit("")))
    order = F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")))
    rows = inner.select(
        "*", name.alias("key"), order.alias("order"), F.substring(order, 1, BUCKET_DIGITS).alias("bucket"),
        F.regexp_count(F.coalesce(col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), col(source_col).alias("source"),
    )
    buckets = cut(rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(buckets.groupBy("key", "source").agg(F.sum("bucket_size").alias("source_size")).drop("key"), weights, share, repeats)
    targets = targets.withColumn("key", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))))
    so_far = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = buckets.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)).alias("bucket_begin"))
    begins = cut(begins.join(targets.drop("source"), "key"))
    in_bucket = Window.partitionBy("key", "bucket").orderBy("order", col(id_col), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("begin", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).drop("source").join(begins, ["key", "bucket"])
    begin = F.col("bucket_begin") + F.col("begin")
    asked = F.round("target").cast("long")
    passes = [F.greatest(F.least(asked - F.col("source_size") * p - begin, F.col("size")), F.lit(0)) for p in range(repeats)]
    taken = sum(passes[1:], passes[0])
    shape = F.col("rank") % len(schedules)
    positions = []
    for p, words in enumerate(passes):
        done = (F.col("source_size") * p + begin) / F.col("target")
        time = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            time = F.when(shape == k, demand_time(schedule, done)).otherwise(time)
        positions.append(F.when(words > 0, time))
    new = ["size", "source_size", "target", "taken", "taken_by_pass", "positions"]
    return placed.select(
        *[c for c, n in zip(restored, df.columns, strict=True) if n not in new],
        "size", "source_size", "target", taken.alias("taken"), F.array(*passes).alias("taken_by_pass"), F.array(*positions).alias("positions"),
    )


def in_training_order(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows dealt into ranges of the training ``position`` and sorted by it; rows without one come last.

    A hash of the id follows the position, so that the rows without one are dealt out too.
    """
    position, tie = F.col("position").asc_nulls_last(), F.xxhash64(id_col)
    return plan.repartitionByRange(position, tie).sortWithinPartitions(position, tie)


def curriculum(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself in training order: a row for each pass over a row of ``df`` that takes words.

    Returns the columns of ``df`` (those that clash with the new names give way) and ``taken``
    (words of this pass), ``pass`` (from 1) and ``position``. Defined cases: as
    :func:`mixing_plan`; rows of which nothing is taken, those without words among them, are
    left out; a row taken twice over is two rows with a position each; empty input gives no
    rows.
    """
    inner, _, restored = shield(df)
    names = [f"in_{df.columns.index(c)}" for c in (id_col, text_col, source_col)]
    plan = mixing_plan(inner, *names)
    passes = F.posexplode(F.arrays_zip("taken_by_pass", "positions")).alias("nth", "p")
    rows = plan.select(*inner.columns, passes).filter("p.taken_by_pass > 0")
    new = ["taken", "pass", "position"]
    ordered = in_training_order(rows.withColumn("position", F.col("p.positions")), names[0])
    return ordered.select(
        *[c for c, n in zip(restored, df.columns, strict=True) if n not in new],
        F.col("p.taken_by_pass").alias("taken"), (F.col("nth") + 1).alias("pass"), "position",
    )
