"""Hops over stored nested rows against traversals, and their plan."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import graph as g
from vertexloom.operators.nested import nested_ego, store_adjacency
from vertexloom.operators.traversal import Traversal

EDGES = "edge_id string, src_id long, dst_id long, label string, properties map<string,array<string>>, event_time timestamp_ntz, source string"


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(4)
    pairs = [(1, n) for n in range(2, 40)] + [(rnd.randint(1, 60), rnd.randint(1, 60)) for _ in range(90)] + [(7, 7)]
    edges = spark.createDataFrame([(f"e{k}", a, b, rnd.choice("xy"), {}, None, None) for k, (a, b) in enumerate(pairs)], EDGES)
    nodes = spark.createDataFrame([(n, "n", {}) for n in range(1, 65)], "node_id long, label string, properties map<string,array<string>>")
    return g.Graph(nodes, edges)


@pytest.fixture(scope="module")
def stored(spark, graph, tmp_path_factory):
    before, g.CHUNK_LINKS = g.CHUNK_LINKS, 10  # the hub has several rows
    try:
        return store_adjacency(graph, "nested_test", str(tmp_path_factory.mktemp("adjacency")), 4)
    finally:
        g.CHUNK_LINKS = before


def rows(df):
    return sorted(tuple(r[c] for c in ("src_id", "dst_id", "direction", "lvl", "edge_id", "edge_label")) for r in df.collect())


@pytest.mark.parametrize("hops", range(1, 6))
def test_same_as_repeated_hops(spark, graph, stored, hops):
    assert stored.filter("node_id = 1").count() > 3
    start = spark.createDataFrame([(2,), (50,), (999,), (2,)], "node_id long")
    assert rows(nested_ego(stored, start, hops)) == rows(Traversal(graph, start).repeat(lambda t: t.both(), times=hops).project("id"))


def test_one_direction_and_some_links(spark, graph, stored):
    start = spark.createDataFrame([(1,), (7,)], "node_id long")
    assert rows(nested_ego(stored, start, 2, "out", lambda e: e["label"] == "x")) == rows(Traversal(graph, start).out("x").out("x").project("id"))
    assert rows(nested_ego(stored, start.limit(0), 2)) == []


def test_stored_rows_are_not_shuffled(spark, stored):
    start = spark.createDataFrame([(n,) for n in range(20)], "node_id long").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.join(start.distinct(), "node_id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    lines = plan.split("\n")
    depth = lambda line: len(re.match(r"[\s:+|-]*", line).group())
    scan = next(i for i, line in enumerate(lines) if "nested_test" in line)
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            at = depth(line)
            above.append(line)
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)


def test_hop_is_right_without_broadcast(spark, graph, stored):
    start = graph.vertices.select("node_id").filter(F.col("node_id") % 3 == 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(nested_ego(stored, start, 1)) == rows(Traversal(graph, start).both().project("id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_more_shuffle_partitions_than_buckets(spark, graph, tmp_path):
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        few = store_adjacency(graph, "nested_few", str(tmp_path / "adjacency"), 2)
        start = spark.createDataFrame([(n,) for n in (1, 7, 50)], "node_id long")
        plan = few.join(start.distinct(), "node_id", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # that of the frontier only
        assert rows(nested_ego(few, start, 2)) == rows(Traversal(graph, start).both().both().project("id"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edge_list_of_whole_rows_is_not_compared(spark):
    links = [("a", 1, 2), ("b", 2, 1), ("c", 1, 1), ("d", 9, 2), ("e", None, 1), ("f", 1, 3)]  # 9 is no vertex, neither is null
    edges = spark.createDataFrame([(i, x, y, "x", {}, None, None) for i, x, y in links], EDGES)
    some = g.Graph(spark.createDataFrame([(n, "n", {}) for n in (1, 2, 3)], "node_id long, label string, properties map<string,array<string>>"), edges)
    listed = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert [r.node_id for r in g.unlisted_sources(some).orderBy("node_id").collect()] == [None, 9]
    found = g.edges_of_adjacency(g.adjacency(some), g.unlisted_sources(some))
    assert listed(found) == listed(g.edges_of_adjacency(g.adjacency(some))) == sorted(((*x, "x") for x in links), key=str)
    whole = g.Graph(some.vertices, edges.filter("src_id < 9"))
    found = g.edges_of_adjacency(g.adjacency(whole), g.unlisted_sources(whole))
    assert listed(found) == sorted(((*x, "x") for x in links if x[1] in (1, 2)), key=str)
    assert "hashpartitioning(edge_id" not in found._jdf.queryExecution().executedPlan().toString()
