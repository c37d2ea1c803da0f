"""Many cases and many requests at once, and communications at a busy place."""

from __future__ import annotations

import datetime as dt
import random

from vertexloom.operators.graph import Graph
from vertexloom.operators.traversal import Traversal
from vertexloom.plans import cases, many
from vertexloom.plans.investigations import Scope, communicated_after

EDGES = "edge_id string, src_id long, dst_id long, label string, properties map<string,array<string>>, event_time timestamp_ntz, source string"
T = dt.datetime(2024, 1, 1)


def graph_of(spark, links):
    edges = spark.createDataFrame([(f"e{k}", a, b, label, {}, at, "s") for k, (a, label, b, at) in enumerate(links)], EDGES)
    nodes = spark.createDataFrame([(n, "n", {}) for n in range(100)], "node_id long, label string, properties map<string,array<string>>")
    return Graph(nodes, edges)


def test_each_case_has_what_it_would_have_alone(spark):
    rnd = random.Random(1)
    graph = graph_of(spark, [(rnd.randint(0, 30), rnd.choice("ab"), rnd.randint(0, 30), T + dt.timedelta(days=rnd.randint(0, 9))) for _ in range(150)] + [(1, "a", n, T) for n in range(50)])
    starts = {"x": [1, 2], "y": [1], "z": [99], "none": [5, 6, 7]}
    df = spark.createDataFrame([(c, n) for c, ns in starts.items() for n in ns + ns[:1]], "case_id string, node_id long")
    scope = Scope((T, T + dt.timedelta(days=5)), ("s",))
    found = many.investigate_cases(graph, df, [("both", "a"), ("out", None), ("in", "b")], scope)
    got = {c: sorted(tuple(r)[1:] for r in found.rows().filter(f"case_id = '{c}'").collect()) for c in starts}
    for c, ns in starts.items():
        start = spark.createDataFrame([(n,) for n in ns], "node_id long")
        alone = scope.path(("both", "a"), ("out", None), ("in", "b"))(Traversal(graph, start)).project("id")
        assert got[c] == sorted(tuple(r) for r in alone.collect())
    assert got["z"] == [] and got["x"]
    assert {r.node_id for r in found.vertices().filter("case_id = 'y'").collect()} == {n for row in got["y"] for n in row[:2]}


def test_starts_match_the_query_of_their_own_case(spark):
    node = "struct<node_id:long,property:string,value:string>"
    ask = "struct<propertyKey:string,propertyValue:string>"
    rows = [
        ("a", [(1, "user", "Bob"), (2, "user", "eve"), (3, "ip", "bob")], [("user", "bOB")]), ("b", [(1, "user", "Bob"), (4, "ip", None)], [("user", "ALL")]),
        ("c", [], [("user", "all")]), ("d", [(1, "user", "x")], []), ("e", None, None),
    ]
    df = spark.createDataFrame(rows, f"case_id string, nodes array<{node}>, query array<{ask}>")
    assert sorted(tuple(r) for r in many.case_starts(df).collect()) == [("a", 1), ("b", 1)]


def test_requests_are_covered_as_one_by_one(spark):
    rnd = random.Random(2)
    keys = ["user", "ip", "host"]
    pick = lambda n: [(rnd.choice(keys), rnd.choice(["A", "a", "b", "C", "d"])) for _ in range(n)]
    known = [
        (f"c{i}", pick(rnd.randint(0, 5)), [(i, *p) for p in pick(rnd.randint(0, 3))], T, T + dt.timedelta(days=rnd.randint(1, 9)), rnd.choice([["all"], ["m"], ["m", "w"]]))
        for i in range(60)
    ] + [("null", None, None, T, T + dt.timedelta(days=30), ["all"])]
    asked = [(f"r{i}", pick(rnd.randint(0, 3)), T + dt.timedelta(days=1), T + dt.timedelta(days=rnd.randint(1, 6)), rnd.choice([["m"], ["w"], ["m", "w"]])) for i in range(40)]
    asked += [("twice", [("user", "a"), ("user", "A")], T, T, ["m"]), ("unknown", [("user", "nobody")], T, T, ["m"]), ("null", None, T, T, ["m"])]
    pairs = "array<struct<propertyKey:string,propertyValue:string>>"
    held = spark.createDataFrame(known, f"case_id string, query {pairs}, nodes array<struct<node_id:long,property:string,value:string>>, query_start timestamp_ntz, query_end timestamp_ntz, datasources array<string>")
    requests = spark.createDataFrame(asked, f"request_id string, query {pairs}, query_start timestamp_ntz, query_end timestamp_ntz, datasources array<string>")
    want = set()
    for r, query, start, end, sources in asked:
        for c, own, nodes, low, high, has in known:
            have = {(k, v.lower()) for k, v in own or []} | {(k, v.lower()) for _, k, v in nodes or []}
            if query and {(k, v.lower()) for k, v in query} <= have and low <= start and high >= end and ("all" in has or set(sources) <= set(has)):
                want.add((r, c))
    got = cases.covered_requests(held, requests).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 20
    assert cases.covered_requests(held, requests.limit(0)).collect() == [] == cases.covered_requests(held.limit(0), requests).collect()


def test_busy_place(spark):
    rnd = random.Random(3)
    hour = lambda h: T + dt.timedelta(hours=h)
    seen = [(p, rnd.choice([50, 51]), hour(rnd.randint(0, 200))) for p in range(20)]
    talk = [(50 if rnd.random() < 0.5 else rnd.randint(50, 60), 70 + k % 9, T + dt.timedelta(minutes=rnd.randint(-500, 15000))) for k in range(600)]
    talk += [(50, 71, at) for _, place, at in seen if place == 50] + [(50, 72, at + dt.timedelta(hours=5)) for _, place, at in seen if place == 50]
    graph = graph_of(spark, [(p, "downloadedOn", place, at) for p, place, at in seen] + [(a, "IPsCommunicated", b, at) for a, b, at in talk])
    found = communicated_after(graph, spark.createDataFrame([(p,) for p in range(20)], "node_id long"), "5 hours")
    got = sorted((r.process_id, r.place_id, r.edge_id, r.other_id) for r in found.collect())
    want = []
    for p, place, at in seen:
        for k, (a, b, when) in enumerate(talk, len(seen)):
            want += [(p, place, f"e{k}", other) for near, other in ((a, b), (b, a)) if near == place and at <= when < at + dt.timedelta(hours=5)]
    assert got == sorted(want) and len(got) >= 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(place_id" in plan and "stretch" in plan.split("Join Inner")[1].split("\n")[0]


def test_requests_meet_cases_by_time(spark):
    """Many requests for what many cases hold, at other times: the joins must not make their pairs."""
    n = 300
    at = lambda k: T + dt.timedelta(hours=k)
    pairs = "array<struct<propertyKey:string,propertyValue:string>>"
    known = [(k, [("user", "A"), ("ip", f"{k % 2}")], [], at(30 * k), at(30 * k + k % 30), ["all"]) for k in range(n)]
    known += [(n, [("user", "a"), ("ip", "1")], [], T, at(30 * n), ["all"]), (n + 1, [("user", "a"), ("ip", "0")], [], at(9), at(5), ["m"])]
    asked = [(k, [("USER".lower(), "a"), ("ip", f"{k % 2}")], at(30 * k + k % 7), at(30 * k + k % 11), ["m"]) for k in range(n)]
    held = spark.createDataFrame(known, f"case_id long, query {pairs}, nodes array<struct<node_id:long,property:string,value:string>>, query_start timestamp_ntz, query_end timestamp_ntz, datasources array<string>")
    requests = spark.createDataFrame(asked, f"request_id long, query {pairs}, query_start timestamp_ntz, query_end timestamp_ntz, datasources array<string>")
    want = {(r, c) for r, query, start, end, _ in asked for c, own, _, low, high, _ in known if query[1] == own[1] and low <= start and high >= end}
    found = cases.covered_requests(held, requests)
    got = [tuple(x) for x in found.collect()]
    assert set(got) == want and len(got) == len(want) > n // 2 and any(asked[r][2] > asked[r][3] for r, _ in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.split("\n") if "Join Inner" in line)
    assert all(x in join for x in ("asks", "stretch", "case_start", "request_end", "request_sources"))
    zoned = lambda df: df.withColumns({c: df[c].cast("timestamp") for c in ("query_start", "query_end")})
    assert {tuple(x) for x in cases.covered_requests(zoned(held), zoned(requests)).collect()} == want
