import math
import random

import pytest
from pyspark.sql import functions as F

from tricolor.operators import neighbor_info as ni


def brute(rows, k):
    """rows of (x, y): the estimator by comparing all pairs."""
    psi = lambda n: sum(1 / i for i in range(1, n))  # noqa: E731  (less Euler's constant, which cancels)
    size = {}
    for _, y in rows:
        size[y] = size.get(y, 0) + 1
    rows = [(x, y) for x, y in rows if size[y] > 1]
    total = 0.0
    for i, (x, y) in enumerate(rows):
        d = sorted(abs(x - b) for j, (b, c) in enumerate(rows) if j != i and c == y)
        kk = min(k, size[y] - 1)
        r = d[kk - 1]
        m = sum(abs(x - b) < r if r else b == x for b, _ in rows)
        total += psi(kk) - psi(size[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("run", [1 << 16, 8])
def test_equals_all_pairs(spark, monkeypatch, run):
    monkeypatch.setattr(ni, "RUN", run)
    rng = random.Random(3)
    rows = []
    for i in range(260):
        y = rng.choice([0, 0, 1, 2])
        rows.append((rng.randint(0, 5000) + 900 * y, rng.randint(0, 6), rng.randint(-40, 40) * (y + 1), y))
    rows += [(1, 1, 1, 3), (7, 7, 7, 4), (9, 9, 9, 4)]   # alone, and a pair
    df = spark.createDataFrame([tuple(map(float, r[:3])) + (r[3],) for r in rows], "a double, b double, c double, y int")
    for k in (1, 3):
        got = {r.feature: r.importance for r in ni.neighbor_information(df, ["a", "b", "c"], "y", k).collect()}
        for j, c in enumerate("abc"):
            assert got[c] == pytest.approx(brute([(r[j], r[3]) for r in rows], k), abs=1e-9)


def test_nulls_non_finite_and_hot_values(spark):
    rows = [(1.0, 0)] * 300 + [(float(i), i % 2) for i in range(2, 60)] + [(None, 1), (float("nan"), 1), (float("inf"), 0), (5.0, None), (-0.0, 1), (0.0, 1)]
    df = spark.createDataFrame(rows, "x double, y int")
    kept = [(x + 0.0, y) for x, y in rows if x is not None and y is not None and math.isfinite(x)]
    assert ni.neighbor_information(df, ["x"], "y").first().importance == pytest.approx(brute(kept, 3), abs=1e-9)
    assert ni.neighbor_information(df.where("false"), ["x"], "y").collect() == []


def test_no_single_partition_window_and_harmonics(spark):
    df = spark.range(50).select((F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    plan = ni.radii(ni._values(df, ["x"], "y"), 3)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("ExistingRDD")[0]
    windows = [line for line in top.splitlines() if "Window [" in line and "_tc_pid" not in line]
    assert windows and all("[run#" in line or "run" in line for line in windows)
    n = spark.createDataFrame([(i,) for i in (0, 1, 2, 63, 64, 65, 1000)], "n long")
    for r in n.select("n", ni.harmonic(F.col("n")).alias("h")).collect():
        assert r.h == pytest.approx(sum(1 / i for i in range(1, r.n + 1)), abs=1e-12)
