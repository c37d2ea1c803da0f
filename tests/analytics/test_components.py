"""Connected components on chains, stars, loops and nothing."""

from __future__ import annotations

import random

from vertexloom.analytics import components
from vertexloom.analytics.components import connected_components


def test_shapes(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    ring = [(10, 11), (11, 12), (12, 10)]
    loops = [(900, 900), (None, 3), (4, None), (11, 10)]
    edges = chain + star + ring + loops
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {10: 10, 11: 10, 12: 10, 900: 900}
    assert got == expected


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_links_take_no_rounds_and_many_agree(spark, monkeypatch):
    rows = [(f"n{a}", f"n{b}") for a, b in [(i, i + 1) for i in range(40) if i % 9]] + [("é", "z"), ("z", "\U0001f600"), ("s", "s"), (None, "q")]
    edges = spark.createDataFrame(rows, "a string, b string").repartition(3)
    got = components.connected_components(edges, max_rounds=0).collect()  # no round of shuffles
    least = {r.node: r.component for r in got}
    assert len(got) == len(least) and least["\U0001f600"] == "z" and least["s"] == "s" and "q" not in least
    for a, b in rows[:-1]:
        assert least[a] == least[b] <= min(a, b)
    for limit in (1, 7):
        monkeypatch.setattr(components, "TASK_LINKS", limit)
        assert sorted(components.connected_components(edges).collect()) == sorted(got)
