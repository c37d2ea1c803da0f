"""Traversals of many cases in one job: every row knows the case that it was reached from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.operators.graph import Graph
from vertexloom.operators.traversal import Traversal
from vertexloom.plans.investigations import Scope

Hop = tuple[str | None, ...]


def case_starts(cases: DataFrame) -> DataFrame:
    """``case_id, node_id``: of every case the vertices that match its own query, any case of letters, ``all`` being any value.

    ``cases``: case_id, nodes (array of node_id, property, value), query (array of
    propertyKey, propertyValue).
    """
    nodes = cases.select("case_id", F.explode("nodes").alias("n")).select("case_id", "n.*")
    asked = cases.select(F.col("case_id").alias("asking"), F.explode("query").alias("q")).select("asking", "q.*")
    same = (F.lower("propertyValue") == "all") | (F.lower("value") == F.lower("propertyValue"))
    return nodes.join(asked, (F.col("case_id") == F.col("asking")) & (F.col("property") == F.col("propertyKey")) & same, "left_semi").select("case_id", "node_id").distinct()


@dataclass(frozen=True)
class CaseFrames:
    """``levels``: for each hop the frontier before it (case_id, node_id) and the edges crossed from it, each once for all cases."""

    graph: Graph
    levels: tuple[tuple[DataFrame, DataFrame], ...]
    reached: DataFrame

    def rows(self) -> DataFrame:
        """``case_id`` and ids, direction, level and edge, as stored, of every row of every case. Self loops are left out."""
        found = None
        for front, crossed in self.levels:
            joined = crossed.join(front, F.col("prev_id") == F.col("node_id"))
            stored = F.col("direction") == "out"
            rows = joined.select(
                "case_id", F.when(stored, F.col("prev_id")).otherwise(F.col("cur_id")).alias("src_id"), F.when(stored, F.col("cur_id")).otherwise(F.col("prev_id")).alias("dst_id"),
                "direction", F.col("lvl").cast("int").alias("lvl"), "edge_id", "edge_label",
            )
            found = rows if found is None else found.unionByName(rows)
        return found.filter("src_id <> dst_id")

    def vertices(self) -> DataFrame:
        """``case_id, node_id, label, properties`` of all vertices of each case."""
        ids = self.rows().select("case_id", F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
        return ids.join(self.graph.vertices.select("node_id", "label", "properties"), "node_id").select("case_id", "node_id", "label", "properties")


def investigate_cases(graph: Graph, starts: DataFrame, hops: Sequence[Hop], scope: Scope = Scope()) -> CaseFrames:  # noqa: B008
    """The same hops (direction, edge label, vertex label; labels being optional) for any number of cases.

    Frontiers are keyed by case and vertex and distinct. The edges of a hop are found from the
    distinct vertices of all frontiers together, so a hub that many cases reach is expanded
    once; only the distinct pairs of neighbours meet the frontiers. Both are checkpointed.
    """
    front, levels = cut(starts.select("case_id", "node_id").distinct()), []
    for n, hop in enumerate(hops, 1):
        shared = Traversal(graph, front.select("node_id").distinct())
        crossed = cut(scope.hop(shared, *hop).last.withColumn("lvl", F.lit(n)))
        levels.append((front, crossed))
        pairs = crossed.select("prev_id", "cur_id").distinct()
        front = cut(front.join(pairs, F.col("node_id") == F.col("prev_id")).select("case_id", F.col("cur_id").alias("node_id")).distinct())
    return CaseFrames(graph, tuple(levels), front)
