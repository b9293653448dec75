"""Search by cells and residual codes against the exact search."""

import numpy as np
import pytest

from citelens.operators import quantised, vectors

SCHEMA = "id long, chunk int, embedding array<double>"


def recall(spark, x, asked, **shape):
    rows = spark.createDataFrame([(i // 2, i % 2, v.tolist()) for i, v in enumerate(x)], SCHEMA).cache()
    queries = spark.createDataFrame([(q, x[q].tolist()) for q in asked], "query long, embedding array<double>").cache()
    fitted = quantised.fit(rows, sample=4000, codes=shape.pop("codes", 64), parts=16)
    got = quantised.search(quantised.index(rows, fitted), rows, queries, fitted, 10, **shape).collect()
    told = {(r.query, r.id, r.chunk): r.distance for r in vectors.nearest(rows, queries, 10).collect()}
    assert all(abs(told[r.query, r.id, r.chunk] - r.distance) < 1e-9 for r in got if (r.query, r.id, r.chunk) in told)
    for q in asked:
        assert sorted(r.rank for r in got if r.query == q) == list(range(1, 11))
    return len(fitted.cells), sum((r.query, r.id, r.chunk) in told for r in got) / len(told)


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, clustered):
    """8000 vectors in 100 cells, of which each query looks into a quarter (clustered) or two thirds; blocks of a cell's rows and queries."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 32))
    if clustered:
        x = x * 0.3 + rng.normal(size=(60, 32))[rng.integers(0, 60, 8000)]
    cells, found = recall(spark, x, range(0, 8000, 100), probe=25 if clustered else 66, block=50, together=20)
    assert cells >= 90 and found >= 0.9


def test_a_third_of_equal_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile(rng.normal(size=32), (500, 1)), rng.normal(size=(1000, 32))])
    _, found = recall(spark, x, [0, 700, 1400], probe=100, block=100)
    assert found >= 0.9


def test_odd_rows_and_few_rows(spark):
    odd = [(9, 0, None), (9, 1, []), (9, 2, [1.0]), (9, 3, [float("nan"), 1.0]), (9, 4, [None, 1.0])]
    rows = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [3.0, 4.0]), *odd], SCHEMA)
    fitted = quantised.fit(rows)
    indexed = quantised.index(rows, fitted)
    assert {(r.id, len(r.codes)) for r in indexed.collect()} == {(1, 2), (2, 2)}
    queries = spark.createDataFrame([(7, [0.0, 0.0]), (8, None), (9, [1.0])], "query long, embedding array<double>")
    got = quantised.search(indexed, rows, queries, fitted, 5).collect()
    assert sorted((r.query, r.id, r.rank, r.distance) for r in got) == [(7, 1, 1, 0.0), (7, 2, 2, 5.0)]
    assert quantised.fit(rows.limit(0)) is None and quantised.fit(rows.filter("id = 9 AND chunk < 2")) is None
