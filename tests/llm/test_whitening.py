"""Bit-sliced whitening against plain integer sums and numpy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import whitening as wh

SF = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 7), st.sampled_from([1, 3, 300, 2**31, 2**62]))
def test_cross_products_are_exact(seed, rows, dim, spread):
    block = np.random.default_rng(seed).integers(-spread, spread + 1, (rows, dim))
    if seed % 3 == 0:
        block[:, 0] = block[0, 0]
    sums, product = wh.cross_products(block)
    exact = [[int(v) for v in row] for row in block]
    assert sums == [sum(r[i] for r in exact) for i in range(dim)]
    assert all(product[i][j] == sum(r[i] * r[j] for r in exact) for i in range(dim) for j in range(i, dim))


def plain(rows):
    """Fit list, its covariance, and the exact deviations of (id, vector) rows."""
    x = {i: tuple(math.floor(256.0 * float(np.float32(c))) for c in v) for i, v in rows}
    distinct = np.array(sorted(set(x.values())), object)
    n, sums = len(distinct), distinct.sum(0)
    centred = n * distinct - sums
    covariance = (centred.T @ centred) / n**3
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    return x, n, sums, covariance.astype(float), deviation


def check(made, rows, components=4):
    x, n, sums, covariance, deviation = plain(rows)
    values, vectors = np.linalg.eigh(covariance)
    by_component = {}
    for r in made:
        assert r["n"] == n and int(r["deviation"]) == deviation[r["vec_id"]]
        assert r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(values[-r["component"]] / values.sum(), rel=1e-9)
        by_component.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    assert sorted(by_component) == list(range(1, components + 1))
    for c, got in by_component.items():
        expected = {i: float((np.array(v, float) - (sums / n).astype(float)) @ vectors[:, -c]) / math.sqrt(values[-c]) for i, v in x.items()}
        assert set(got) == set(expected)
        largest = max(expected, key=lambda i: abs(expected[i]))
        sign = math.copysign(1, got[largest] * expected[largest])
        assert all(got[i] == pytest.approx(sign * expected[i], abs=1e-6) for i in got)


def test_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(wh.whiten(table).collect(), rows)


def test_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_ROWS", 64)
    pick = np.random.default_rng(5)
    vectors = [pick.normal(size=6).astype("f4").tolist() for _ in range(150)]
    vectors += [vectors[0]] * 100 + [[c + 1e-5 for c in vectors[1]]]
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, embedding array<float>, n int, x int").repartition(3)
    check(wh.whiten(frame).collect(), rows)


def test_unusable_rows_and_repeated_ids(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0])]
    good = [(None, [0.5, 0.25]), (7, [0.1, -0.2]), (7, [0.1, -0.2]), (8, [-1.0, 2.0])]
    made = wh.whiten(spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in made) == sorted((i or 0, c) for i, _ in good for c in (1, 2))
    assert {r["n"] for r in made} == {3}


def test_no_variance_empty_and_mixed_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    one = wh.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0)] * 4
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    line = wh.whiten(spark.createDataFrame([(i, [i / 4, i / 2, 0.0]) for i in range(5)], schema)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    mixed = wh.whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["dim"]) for r in mixed) == [(1, 1, 1), (2, 1, 1), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]


def test_extreme_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 1e17])]
    made = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(made) == 6 and all(r["n"] == 3 for r in made)
