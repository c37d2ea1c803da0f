"""The mix against water-filling by hand, and its order against its schedules."""

from __future__ import annotations

import re

import pytest

from vertexloom.llm import mixing

DOCS = "/root/testdata/sf0.01/documents.parquet"


def water_fill(sizes, share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        level = left / total
        full = {s for s in open_ if target[s] + level * weight[s] >= repeats * sizes[s]}
        if not full:
            for s in open_:
                target[s] += level * weight[s]
            break
        for s in full:
            left -= repeats * sizes[s] - target[s]
            target[s] = repeats * sizes[s]
        open_ -= full
    return target


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 7 if i % 3 else 0}", 1) for i in range(600)]
    rows += [(1000 + i, "x y z", None, 1) for i in range(9)] + [(2000, None, "s1", 1), (2001, "", "empty", 1), (2002, "v " * 20000, "s2", 1), (7, "w " * 7, "s1", 1), (None, "a b", "s3", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mixing_plan(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = water_fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken <= 2 * r.size and r.taken == sum(r.taken_by_pass)
        assert all((p is None) == (n == 0) and 0 <= (p or 0) <= 1 for p, n in zip(r.positions, r.taken_by_pass, strict=True))
        assert r.positions[1] is None or r.positions[0] is None or r.positions[0] < r.positions[1]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixing_plan(df.repartition(7)).collect()))
    assert mixing.mixing_plan(df.limit(0)).collect() == []


def test_demand_is_inverted(spark):
    for schedule in (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.0), (0.25, 2.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 3.0), (0.5, 0.0), (1.0, 1.0))):
        df = spark.range(101).selectExpr("id / 100 as u")
        for r in df.select("u", mixing.demand_time(schedule, df["u"]).alias("t")).collect():
            area = total = 0.0
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
                total += (t1 - t0) * (w0 + w1) / 2
                end = min(max(r.t, t0), t1)
                w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                area += (end - t0) * (w0 + w) / 2
            assert area / total == pytest.approx(r.u, abs=1e-9)


def test_curriculum_is_sorted_by_range(spark):
    df = spark.read.parquet(DOCS)
    mixed = mixing.curriculum(df)
    assert mixed.columns == [*df.columns, "taken", "pass", "position"]
    parts = mixed.select("position").rdd.glom().map(lambda rows: [r.position for r in rows]).collect()
    flat = [p for part in parts for p in part]
    assert flat == sorted(flat) and len(flat) > 500
    planned = mixing.mixing_plan(df).collect()
    assert len(flat) == sum(n > 0 for r in planned for n in r.taken_by_pass)
    assert mixed.agg({"taken": "sum"}).first()[0] == sum(r.taken for r in planned)


def test_curriculum_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", "t", 0.5, "w", "k")], "doc_id long, text string, source string, taken string, position double, whole_row string, key string")
    mixed = mixing.curriculum(df)
    assert mixed.columns == ["doc_id", "text", "source", "whole_row", "key", "taken", "pass", "position"]
    row = mixed.first()
    assert (row.taken, row.whole_row, row.key) == (2, "w", "k")
    assert mixing.curriculum(df.limit(0)).collect() == []
