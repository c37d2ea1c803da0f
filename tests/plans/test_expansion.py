"""Expansion over several sources against a breadth-first search, and its plan."""

from __future__ import annotations

import datetime as dt
import random

from vertexloom.plans.expansion import EventSource, expand_sources, reached, runtime_filters

T = dt.datetime(2024, 1, 1)


def sources_of(spark, rows_a, rows_b):
    a = spark.createDataFrame(rows_a, "id long, at timestamp_ntz, who string, ip string")
    b = spark.createDataFrame(rows_b, "n int, ts timestamp_ntz, host string, seen string, other string")
    return [EventSource("a", a, "id", "at", {"user": ["who"], "ip": ["ip"]}), EventSource("b", b, "n", "ts", {"host": ["host"], "ip": ["seen", "other"]})]


def test_same_as_breadth_first(spark):
    rnd = random.Random(6)
    at = lambda: T + dt.timedelta(hours=rnd.randint(0, 100))
    ip = lambda: rnd.choice([None, "-", *[f"I{n}" for n in range(40)]])
    rows_a = [(i, at(), rnd.choice(["Ann", "bob", "I3", None]) if rnd.random() < 0.1 else f"u{i}", ip()) for i in range(80)]
    rows_b = [(i, at(), f"h{i % 30}", ip(), ip()) for i in range(80)] + [(3, T, None, None, None)]
    time = (T, T + dt.timedelta(hours=80))
    names = {}
    for i, when, who, seen in rows_a:
        if time[0] <= when <= time[1]:
            names.setdefault(("a", i), set()).update({("user", who), ("ip", seen)})
    for i, when, host, seen, other in rows_b:
        if time[0] <= when <= time[1]:
            names.setdefault(("b", i), set()).update({("host", host), ("ip", seen), ("ip", other)})
    names = {e: {(k, v.lower()) for k, v in vs if v and v != "-"} for e, vs in names.items()}
    values, seen, want = {("user", "ann"), ("ip", "i3"), ("user", "u5")}, set(), {}
    for level in range(4):
        seen |= values
        fresh = {e for e, vs in names.items() if vs & values and e not in want}
        want |= dict.fromkeys(fresh, level)
        values = set().union(*[names[e] for e in fresh]) - seen
    seeds = spark.createDataFrame([("user", "ANN"), ("ip", "i3"), ("user", "u5"), ("ip", "-")], "kind string, value string")
    got = expand_sources(sources_of(spark, rows_a, rows_b), seeds, 4, time).collect()
    assert {(r.source, r.event_id): r.level for r in got} == want and len(got) == len(want) and set(want.values()) == {0, 1, 2, 3}
    assert expand_sources(sources_of(spark, rows_a, rows_b), seeds.limit(0), 2).collect() == []


def test_large_frontiers_reach_the_scan_as_bloom_filters(spark, tmp_path):
    spark.range(20000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as at", "'u' || id as who").write.parquet(f"{tmp_path}/events")
    spark.range(300).selectExpr("'user' as kind", "'u' || (id * 7) as value").write.parquet(f"{tmp_path}/values")
    source = EventSource("a", spark.read.parquet(f"{tmp_path}/events"), "id", "at", {"user": ["who"]})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with runtime_filters(spark):
            found = reached(source, spark.read.parquet(f"{tmp_path}/values"), (T, T + dt.timedelta(seconds=1000)))
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert sorted(r.event_id for r in found.collect()) == [7 * n for n in range(143)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "might_contain" in plan and "bloom_filter_agg" in plan
    assert "PushedFilters: [" in found._jdf.queryExecution().executedPlan().toString()
