import math

import pytest
from pyspark.sql import functions as F

from tricolor.functions import scalar as fn


def test_feature_ops_and_edge_values(spark):
    df = spark.createDataFrame([(4.0, 0.0), (-1.0, 2.0), (-3.0, -1e-9)], "a double, b double")
    r = df.select(*[fn.feature_expr(op, "a", "b").alias(op) for op in fn.FEATURE_OPS]).collect()
    assert r[0]["Add"] == 4.0 and r[0]["Multiply"] == 0.0 and r[0]["Square"] == 16.0
    assert r[0]["Divide"] == pytest.approx(4.0 / 1e-9)
    assert r[1]["Log"] is None and r[2]["Log"] is None          # x <= -1
    assert r[2]["Divide"] is None                               # exact zero divisor
    assert r[0]["Log"] == pytest.approx(math.log1p(4.0))
    with pytest.raises(ValueError):
        fn.feature_expr("Cube", "a")


def test_traffic_light_partitions_rows(spark):
    rows = [(p, pr) for p in (0, 1) for pr in (0.0, 0.1, 0.15, 0.5, 0.85, 0.9, 1.0)]
    df = spark.createDataFrame(rows, "pred int, prob double")
    out = {(r["pred"], r["prob"]): r["light"] for r in df.select("*", fn.fn_traffic("pred", "prob").alias("light")).collect()}
    assert out[(0, 0.15)] == "Green" and out[(0, 0.1)] == "Green" and out[(0, 0.5)] == "Yellow"
    assert out[(1, 0.85)] == "Red" and out[(1, 0.5)] == "Yellow" and out[(1, 0.1)] == "Yellow"
    assert set(out.values()) <= {"Green", "Yellow", "Red"}
    with pytest.raises(ValueError):
        fn.fn_traffic("pred", "prob", 0.4, 0.9)


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.9)], "pred int, prob double")
    r = df.select(fn.fn_flip_pred(fn.fn_flip_pred("pred")).alias("p"),
                  fn.fn_flip_prob(fn.fn_flip_prob("prob")).alias("q")).collect()
    assert [(x["p"], round(x["q"], 12)) for x in r] == [(0, 0.2), (1, 0.9)]


def test_grids():
    assert fn.logspace(-3, 3, 7)[3] == pytest.approx(1.0)
    assert fn.linspace(0.1, 0.9, 5) == pytest.approx([0.1, 0.3, 0.5, 0.7, 0.9])
    assert fn.int_range(3, 15) == list(range(3, 16))


def test_threshold_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,)], "s double")
    assert [r[0] for r in df.select(fn.fn_threshold("s")).collect()] == [1, 0]
    assert F is not None
