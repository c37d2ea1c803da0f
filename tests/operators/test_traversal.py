"""Traversals on a small graph with a self loop, parallel edges, a cycle and a lone vertex."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import graph as graph_module
from vertexloom.operators.graph import Graph, adjacency, degrees, edges_of_adjacency, vertices_of_adjacency
from vertexloom.operators.predicates import P
from vertexloom.operators.traversal import E, V, reachable
from vertexloom.plans.investigations import Scope, communicated_after, investigate

T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def graph(spark):
    props = "map<string,array<string>>"
    vertices = [
        (1, "user", {"userName": ["ann"], "age": ["9"]}), (2, "user", {"userName": ["bob"], "age": ["10"]}), (3, "IP", {"ip": ["a", "b"]}), (4, "IP", {"ip": []}),
        (5, "process", {}), (6, "URL", {"URL": ["u"]}), (7, "host", None), (8, "host", {"hostname": ["lone"]}),
    ]
    edges = [
        ("e1", 1, 3, "hasIP", {"w": ["1"]}, T, "mail"), ("e2", 1, 3, "hasIP", {"w": ["2"]}, T, "web"), ("e3", 2, 4, "hasIP", {}, T, "mail"), ("e4", 3, 5, "runningProcess", {}, T, "sys"),
        ("e5", 5, 7, "childProcessOn", {}, T, "sys"), ("e6", 7, 1, "loggedIn", {}, T, "sys"), ("e7", 5, 5, "self", {}, None, None), ("e8", 1, 6, "clicked", {}, T, "web"),
        ("e9", 2, 6, "clicked", {}, T + dt.timedelta(days=2), "web"), ("e10", 5, 3, "downloadedOn", {}, T, "sys"), ("e11", 3, 4, "IPsCommunicated", {}, T + dt.timedelta(hours=1), "net"),
        ("e12", 3, 4, "IPsCommunicated", {}, T + dt.timedelta(hours=5), "net"),
    ]
    return Graph(
        spark.createDataFrame(vertices, f"node_id long, label string, properties {props}"),
        spark.createDataFrame(edges, f"edge_id string, src_id long, dst_id long, label string, properties {props}, event_time timestamp_ntz, source string"),
    )


def ids(t):
    return sorted((r.edge_id, r.direction, r.lvl) for r in t.project("id").collect())


def vertices(t):
    return sorted(r.node_id for r in t.properties().collect())


def test_predicates(graph):
    v = V(graph)
    assert vertices(v.with_("ip", "b")) == [3]
    assert vertices(v.with_("userName", P.neq("ann"))) == [2]  # a missing property does not pass
    assert vertices(v.with_("age", P.gt(9))) == [2]
    assert vertices(v.with_("age", P.gt("9"))) == []
    assert vertices(v.with_("age", P.between(9, 10))) == [1, 2]
    assert vertices(v.with_("userName", P.or_(P.eq("ann"), P.like("b%")))) == [1, 2]
    assert vertices(v.with_("userName", P.and_(P.gte("a"), P.lte("b")))) == [1]
    assert vertices(v.with_("age", P.lt(10.5)).with_("age", P.within([9, 11]))) == [1]
    assert vertices(v.with_id(P.in_(1, 8)).with_label("host")) == [8]
    assert vertices(v.with_("ip", P.within())) == []


def test_hops(graph):
    ann = V(graph).with_("userName", "ann")
    assert ids(ann.out("hasIP")) == [("e1", "out", 1), ("e2", "out", 1)]
    assert ids(ann.in_()) == [("e6", "in", 1)]
    assert sorted(ids(ann.both())) == sorted(ids(ann.out()) + ids(ann.in_()))
    assert ids(ann.outE("hasIP").with_("w", 2).inV("IP")) == [("e2", "out", 1)]
    assert ids(ann.outE().with_("source", "web").with_id("e8").inV()) == [("e8", "out", 1)]
    assert ids(ann.out("hasIP").out("runningProcess")) == [("e1", "out", 1), ("e2", "out", 1), ("e4", "out", 2)]
    loop = V(graph).with_id(5).both("self")
    assert loop.last.count() == 2 and ids(loop) == []
    assert ids(V(graph).with_id(8).both()) == []
    with pytest.raises(ValueError):
        ann.outE().outV()
    with pytest.raises(ValueError):
        ann.outE().inE()
    with pytest.raises(ValueError):
        ann.project("other")


def test_branches(graph):
    users = V(graph).with_label("user")
    clicked, has = (lambda t: t.out("clicked")), (lambda t: t.out("hasIP"))
    none = lambda t: t.out("missing")
    assert ids(users.coalesce(has)) == ids(users.out("hasIP"))
    assert ids(users.coalesce(none, clicked, has)) == [("e8", "out", 1), ("e9", "out", 1)]
    assert len(ids(users.union(has, has))) == 2 * len(ids(users.out("hasIP")))
    assert ids(users.out("hasIP").optional(none))[-1][2] == 2
    per = V(graph).with_id(P.within(1, 7)).coalesce(lambda t: t.out("loggedIn"), lambda t: t.out("clicked"), per_vertex=True)
    assert ids(per) == [("e6", "out", 1), ("e8", "out", 1)]


def test_repeat(graph):
    start = V(graph).with_id(3)
    out = lambda t: t.outE().with_label(P.within("runningProcess", "childProcessOn", "loggedIn", "hasIP")).inV()
    assert ids(start.repeat(out, times=1)) == ids(out(start))
    assert sorted(x[2] for x in ids(start.repeat(out, times=4))) == [1, 2, 3, 4, 4]
    assert ids(start.repeat(out, times=4, emit="last")) == [("e1", "out", 4), ("e2", "out", 4)]
    assert ids(start.repeat(out, until=P.eq("host"))) == [("e4", "out", 1), ("e5", "out", 2)]
    assert ids(start.repeat(out, until=P.eq("ann"), key="userName")) == [("e4", "out", 1), ("e5", "out", 2), ("e6", "out", 3)]
    with pytest.raises(RuntimeError, match="after 5 levels"):  # a cycle that never passes
        start.repeat(out, until=P.eq("nobody"), key="userName", max_depth=5)
    with pytest.raises(ValueError):
        start.repeat(out)


def test_projections_and_results(graph):
    t = V(graph).with_id(1).as_("a").out("hasIP").as_("b").out("runningProcess").as_("c")
    assert sorted((r.edge_id, r.tag) for r in t.tagged("b", "c").collect()) == [("e1", "b"), ("e2", "b"), ("e4", "c")]
    assert [r.edge_id for r in t.last_level().collect()] == ["e4"]
    assert {r.dst_label for r in t.first_level("basic").collect()} == {"IP"}
    assert t.project("all").filter("edge_id = 'e4'").first().src_properties == {"ip": ["a", "b"]}
    nodes, edges = t.result()
    assert sorted(r.node_id for r in nodes.collect()) == [1, 3, 5] and edges.count() == 3
    assert E(graph, "self").project("id").count() == 0 and E(graph).last.count() == 12
    assert {r.node_id: r.depth for r in reachable(graph, V(graph).with_id(1).root, "out", 2).collect()} == {1: 0, 3: 1, 6: 1, 4: 2, 5: 2}


def test_cases(spark, graph):
    cases = spark.createDataFrame(
        [("c", [(1, "userName", "Ann"), (2, "userName", "bob"), (3, "ip", "a")], [("userName", "ANN"), ("ip", "ALL")])],
        "case_id string, nodes array<struct<node_id:long,property:string,value:string>>, query array<struct<propertyKey:string,propertyValue:string>>",
    )
    assert vertices(V(graph).with_case(cases, "c")) == [1, 3]
    assert vertices(V(graph).with_case(cases, "other")) == []


def test_adjacency_round_trip(graph):
    rows = adjacency(graph)
    one = rows.filter("node_id = 5").first()
    assert [e.edge_id for e in one.out_edges] == ["e10", "e5", "e7"] and sorted({e.other_id for e in one.in_edges}) == [3, 5]
    alone = rows.filter("node_id = 8").first()
    assert alone.out_edges == alone.in_edges == []
    assert sorted(map(tuple, edges_of_adjacency(rows).collect())) == sorted((r.edge_id, r.src_id, r.dst_id, r.label) for r in graph.edges.collect())
    assert vertices_of_adjacency(rows).count() == 8


def test_hubs_have_several_rows(graph, monkeypatch):
    whole = {r.node_id: r for r in degrees(graph).collect()}
    monkeypatch.setattr(graph_module, "CHUNK_LINKS", 1)
    rows = adjacency(graph)
    assert rows.count() > 8 and vertices_of_adjacency(rows).count() == 8
    assert {r.node_id: (r.o, r.i) for r in rows.groupBy("node_id").agg(F.sum(F.size("out_edges")).alias("o"), F.sum(F.size("in_edges")).alias("i")).collect()} == {n: (r.n_out, r.n_in) for n, r in whole.items()}
    assert sorted(map(tuple, edges_of_adjacency(rows).collect())) == sorted((r.edge_id, r.src_id, r.dst_id, r.label) for r in graph.edges.collect())


def test_steps_on_what_is_reached(graph):
    t = V(graph).both()
    reached = [r.cur_id for r in t.last.collect()]
    assert sorted(r.cur_id for r in t.dedup().last.collect()) == sorted(set(reached))
    assert t.count().first()[0] == len(reached) and V(graph).count().first()[0] == 8
    assert [r.cur_id for r in t.order("cur_id", descending=True).limit(3).last.collect()] == sorted(reached, reverse=True)[:3]
    assert [r.node_id for r in V(graph).order("node_id").limit(2).root.collect()] == sorted(r.node_id for r in graph.vertices.collect())[:2]
    assert V(graph).dedup().count().first()[0] == 8


def test_investigations(graph):
    starts = V(graph).with_label("user").root
    assert ids(investigate(graph, "user_clicked_url", starts, Scope(labels={"URLs": "URL"}))) == [("e8", "out", 1), ("e9", "out", 1)]
    early = Scope(time=(T, T + dt.timedelta(days=1)), sources=("web",))
    assert ids(investigate(graph, "user_URL_user", starts, early)) == [("e8", "in", 2), ("e8", "out", 1)]
    assert ids(investigate(graph, "process_downloaded_on", V(graph).with_id(5).root)) == [("e10", "out", 1)]
    assert {x[0] for x in ids(investigate(graph, "user_process", starts))} == {"e1", "e2", "e3", "e4"}
    found = communicated_after(graph, V(graph).with_id(5).root, "2 hours").collect()
    assert [(r.process_id, r.place_id, r.edge_id, r.other_id) for r in found] == [(5, 3, "e11", 4)]


def test_long_chain_is_followed_to_its_end(spark):
    props = "map<string,array<string>>"
    nodes = spark.createDataFrame([(n, "end" if n == 15 else "n", {}) for n in range(17)], f"node_id long, label string, properties {props}")
    edges = spark.createDataFrame([(f"e{n}", n, n + 1, "next", {}, None, None) for n in range(16)], f"edge_id string, src_id long, dst_id long, label string, properties {props}, event_time timestamp_ntz, source string")
    rows = V(Graph(nodes, edges)).with_id(0).repeat(lambda t: t.out(), until=P.eq("end"))
    assert [i for i, _, _ in sorted(ids(rows), key=lambda r: r[2])] == [f"e{n}" for n in range(15)]
