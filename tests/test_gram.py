"""The blocked Gram aggregate against numpy and Spark's own aggregates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tricolor.operators import gram
from tricolor.operators.profile import corr_matrix


def wide(spark, n, p, missing=0.1, seed=1):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, p)) @ g.normal(size=(p, p)) / p ** 0.5 + 1e6 * g.normal(size=p)
    x[g.random((n, p)) < missing] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    return x, df.select("id", *[F.col("v")[j].alias(f"c{j}") for j in range(p)])


def pairwise(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    return np.corrcoef(x[both, i], x[both, j])[0, 1]


def test_blocks_equal_numpy_and_the_native_aggregate(spark, monkeypatch):
    x, df = wide(spark, 200, 11)
    names = [f"c{j}" for j in range(11)]
    monkeypatch.setattr(gram, "BLOCK", 4)
    got = {(r.col_a, r.col_b): r.corr for r in gram.correlations(df, names).collect()}
    assert len(got) == 121
    for i in range(11):
        for j in range(11):
            assert got[f"c{i}", f"c{j}"] == pytest.approx(pairwise(x, i, j), abs=1e-9)
    for r in corr_matrix(df, names[:5]).collect():
        assert got[r.col_a, r.col_b] == pytest.approx(r["corr"], abs=1e-9)


def test_five_hundred_columns_without_an_expression_per_pair(spark):
    x, df = wide(spark, 40, 500, 0.02)
    out = corr_matrix(df, [f"c{j}" for j in range(500)])
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 400_000
    got = {(r.col_a, r.col_b): r.corr for r in out.where("col_a IN ('c0', 'c63', 'c499')").collect()}
    assert len(got) == 1500
    for i in (0, 63, 499):
        for j in range(0, 500, 37):
            assert got[f"c{i}", f"c{j}"] == pytest.approx(pairwise(x, i, j), abs=1e-9)


def test_nulls_constants_and_odd_values(spark):
    rows = [(1.0, 5.0, None, float("nan"), 1.0), (2.0, 5.0, 1.0, 2.0, None), (4.0, 5.0, None, 3.0, 2.0), (3.0, 5.0, None, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, flat double, one double, odd double, b double")
    got = {(r.col_a, r.col_b): r.corr for r in gram.correlations(df, df.columns).collect()}
    assert got["a", "a"] == 1.0 and got["a", "flat"] is None and got["flat", "flat"] is None and got["a", "one"] is None
    assert np.isnan(got["a", "odd"]) and np.isnan(got["b", "odd"]) and got["one", "odd"] is None
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 4, 3], [1, 2, 7])[0, 1])
    empty = {(r.col_a, r.col_b): r.corr for r in gram.correlations(df.where("a > 9"), df.columns).collect()}
    assert len(empty) == 25 and set(empty.values()) == {None}


def test_products_of_every_group(spark):
    x, df = wide(spark, 150, 70, 0.0)
    got = gram.group_products(df.withColumn("fold", F.col("id") % 3), [f"c{j}" for j in range(70)], "fold")
    for f in range(3):
        rows = x[np.arange(150) % 3 == f]
        n, mean, about = got[f]
        assert n == 50 and np.allclose(mean, rows.mean(0), rtol=1e-12)
        assert np.allclose(about, np.cov(rows.T, bias=True) * 50, rtol=1e-8, atol=1e-6)
