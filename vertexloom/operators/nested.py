"""Hops over nested adjacency rows that are stored by vertex."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.operators.graph import Graph, adjacency

#: Buckets of a stored adjacency; the frontier of a hop is dealt to as many.
BUCKETS = 64


def store_adjacency(graph: Graph, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write the nested rows of a graph as a table in buckets by vertex, sorted, and read it.

    A hub has several rows of bounded size (see :func:`adjacency`), all in one bucket. There
    are as many buckets as the session has shuffle partitions at least: of fewer, Spark would
    shuffle the rows in every join instead of reading them by bucket.
    """
    spark = graph.edges.sparkSession
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = adjacency(graph, buckets)  # dealt by vertex as the buckets are: as many files
    rows.write.bucketBy(buckets, "node_id").sortBy("node_id").option("path", path).option("compression", "zstd").mode("overwrite").saveAsTable(table)
    return spark.table(table)


def _tagged(side: str, keep: Callable) -> Column:
    return F.transform(F.filter(f"{side}_edges", keep), lambda e: F.struct(F.lit(side).alias("direction"), e.alias("e")))


def nested_ego(stored: DataFrame, starts: DataFrame, hops: int, direction: str = "both", link: Callable[[Column], Column] | None = None) -> DataFrame:
    """The neighbourhood of start vertices (``node_id``) up to a number of hops, from stored nested rows.

    Every hop joins the distinct frontier with the rows by vertex, where only the frontier is
    shuffled: the rows lie in buckets already. ``link`` may keep some links only (a condition
    on a struct of edge_id, label, other_id). Returns ``src_id, dst_id, direction, lvl,
    edge_id, edge_label``, as a traversal does, self loops left out.
    """
    front, levels = starts.select("node_id").distinct(), []
    keep = link or (lambda e: F.lit(True))
    for n in range(1, hops + 1):
        at = stored.join(front, "node_id", "left_semi")
        sides = [_tagged(side, keep) for side in ("out", "in") if direction in (side, "both")]
        found = at.select("node_id", F.explode(F.concat(*sides)).alias("x")).select("node_id", "x.direction", "x.e.*", F.lit(n).alias("lvl"))
        found = cut(found) if n < hops else found  # nothing goes on from the last level, the largest
        levels.append(found)
        front = found.select(F.col("other_id").alias("node_id")).distinct()
    out = F.col("direction") == "out"
    rows = reduce(DataFrame.unionByName, levels).select(
        F.when(out, F.col("node_id")).otherwise(F.col("other_id")).alias("src_id"), F.when(out, F.col("other_id")).otherwise(F.col("node_id")).alias("dst_id"),
        "direction", "lvl", "edge_id", F.col("label").alias("edge_label"),
    )
    return rows.filter("src_id <> dst_id")
