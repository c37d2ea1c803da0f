"""Connected components by alternating star contraction, as DataFrame joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.lineage import cut

#: Links that a task contracts at once; so many are not worth rounds of shuffles.
TASK_LINKS = 100_000
#: Types whose order in Python is Spark's.
_PLAIN = ("int", "bigint", "string")


def _contracted(links: DataFrame, pieces: int) -> DataFrame:
    """``u, v``: each node of ``TASK_LINKS`` links at a time with the least node that they connect it with, itself for the least."""
    most = TASK_LINKS

    def forest(held: list[tuple]) -> pd.DataFrame:
        root: dict = {}

        def find(x):  # noqa: ANN001, ANN202
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while x != top:
                root[x], x = top, root[x]
            return top

        for a, b in held:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return pd.DataFrame([(x, find(x)) for x in root], columns=["u", "v"])

    def contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in parts:
            rows = list(zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True))
            while len(held) + len(rows) > most:
                free = most - len(held)
                yield forest(held + rows[:free])
                held, rows = [], rows[free:]
            held += rows
        if held:
            yield forest(held)

    return links.coalesce(pieces).mapInPandas(contract, links.schema)


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours ``v`` of each ``u`` to the least of ``u`` and its neighbours.

    ``pairs`` holds (u, v). With ``larger_only`` only neighbours above ``u`` are linked anew,
    else all of them and ``u`` itself. The minimum is a combinable aggregate and the join
    back is one that adaptive execution can split, so hubs do not gather in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if larger_only:
        linked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node in ``edges``.

    Args:
        edges: two columns of one orderable type, an undirected edge a row. Self loops keep
            their node; rows with a null end are left out; repeats do no harm.

    Returns:
        ``node, component``: the component is its least node. Empty input gives no rows.

    Tasks first contract ``TASK_LINKS`` links at a time, which settles as few as that. Of more,
    large-star and small-star steps alternate until nothing changes (a logarithmic number of
    rounds for chains); each round is checkpointed.
    """
    a, b = edges.columns
    ends = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
        .toDF("u", "v", "whole")
        .filter("whole")
        .select("u", "v")
        .distinct()
    )
    if all(kind in _PLAIN for _, kind in ends.dtypes):
        pieces = max(1, math.ceil(ends.count() / TASK_LINKS))
        ends = cut(_contracted(ends, pieces))
        if pieces == 1:
            return ends.toDF("node", "component")
    nodes = ends.select(F.col("u").alias("node")).unionByName(ends.select(F.col("v").alias("node"))).distinct()
    links = ends.filter("u <> v")
    state = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger_only=True)
        links = cut(_star(large.filter("v < u"), larger_only=False))
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
