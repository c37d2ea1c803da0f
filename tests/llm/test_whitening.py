"""Whitening against dense linear algebra."""

from __future__ import annotations

import math

import numpy as np
import pytest

from vertexloom.llm import registry, whitening

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(8))
def test_pairs_are_those_of_dense_algebra(seed):
    rnd = np.random.default_rng(seed)
    dim, count = int(rnd.integers(1, 90)), int(rnd.integers(1, 9))
    rows = rnd.standard_normal((int(rnd.integers(1, 200)), dim)) * rnd.choice([1.0, 1e4])
    matrix = rows.T @ rows
    values, vectors = whitening.leading_pairs(lambda u: matrix @ u, dim, count)
    wanted = np.linalg.eigvalsh(matrix)[::-1][:count]
    assert np.abs(values - wanted).max() <= 1e-13 * wanted[0]
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() <= 1e-12 * wanted[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_close_and_repeated_eigenvalues():
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((60, 60)))[0]
    spectrum = np.sort(np.concatenate([np.full(5, 9.0), [9.0 - 1e-6, 8.9, 8.89], np.linspace(8.85, 0, 52)]))[::-1]
    matrix = (turn * spectrum) @ turn.T
    values, vectors = whitening.leading_pairs(lambda u: matrix @ u, 60, 8)
    assert np.abs(values - spectrum[:8]).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-11
    assert whitening.leading_pairs(lambda u: 0 * u, 4, 8)[0].tolist() == [0] * 4


def test_minres_solves_indefinite_systems():
    rnd = np.random.default_rng(3)
    turn = np.linalg.qr(rnd.standard_normal((30, 30)))[0]
    matrix = (turn * np.concatenate([np.linspace(-2, -1, 10), np.linspace(1, 3, 20)])) @ turn.T
    b = rnd.standard_normal((30, 4))
    shifts = np.array([0.0, 0.1, -0.2, 0.3])
    x = whitening.minres(lambda v: matrix @ v - v * shifts, b, 60, 1e-13)
    assert np.abs(matrix @ x - x * shifts - b).max() < 1e-9


def dense(vectors):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    z = np.array([[float(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, found = np.linalg.eigh(z.T @ z / n)
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], values[::-1], found[:, ::-1], z


def check(rows, vectors, count=8):
    """``rows`` of the query against ``vectors``, by id."""
    n, deviations, values, found, z = dense(list(vectors.values()))
    got = {}
    for r in rows:
        got.setdefault(r.component, {})[r.vec_id] = r
    for k, of_row in got.items():
        assert of_row.keys() == vectors.keys()
        want = z @ found[:, k - 1] / math.sqrt(values[k - 1])
        have = np.array([of_row[i].whitened for i in vectors])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        for i, d in zip(vectors, deviations, strict=True):
            r = of_row[i]
            assert r.n == n and int(r.deviation) == d and r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-10) and r.identity_error < 1e-10
    return sorted(got)


def test_query_whitens_all_vectors(spark):
    rows = registry.QUERIES["op11_whitening"](spark, SF)
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert check(rows.collect(), {r.vec_id: r.embedding for r in table}) == list(range(1, 9))


def test_defined_cases(spark):
    rnd = np.random.default_rng(1)
    good = {i: [float(np.float32(c)) for c in rnd.standard_normal(5)] for i in range(60)}
    good |= {100 + i: good[3] for i in range(50)}  # a third are equal
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [1.0, float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [1.0]), (205, []), (206, [1e30, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in [*good.items(), *bad]], "vec_id long, embedding array<double>, whitened string, x int")
    assert check(whitening.components(df).collect(), good) == [1, 2, 3, 4, 5]
    model = whitening.fit_whitening(df)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "x", "deviation", "whitened"] and out.count() == len(good)
    assert whitening.components(df.limit(0)).collect() == [] and whitening.fit_whitening(df.limit(0)) is None
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert whitening.components(equal).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)] + [(None, [3.0, 6.0, 7.0])] * 2, "vec_id long, embedding array<float>")
    assert {(r.component, r.n) for r in whitening.components(line).collect()} == {(1, 11)}


def test_deviations_are_exact_beyond_64_bits():
    rows = np.array([[1 << 58, 5], [-(1 << 58), 7], [3, 9]], np.int64)
    model = whitening.Whitening(3, tuple(int(s) for s in rows.astype(object).sum(axis=0)), np.zeros(0), np.zeros((2, 0)), 0.0, 0.0)
    assert model.deviations(rows) == [sum((3 * int(c) - s) ** 2 for c, s in zip(v, model.sums, strict=True)) for v in rows.tolist()]
