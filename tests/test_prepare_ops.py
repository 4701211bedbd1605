import math

import pytest
from pyspark.sql import functions as F

from tricolor.operators import labels as lab
from tricolor.operators.columns import IqrFilter, align_to, drop_non_finite, require_columns, MissingColumnsError
from tricolor.operators.encode import OneHotEncoding
from tricolor.operators.missing import MissingStep, apply_missing, fit_missing
from tricolor.operators.transform import MinMaxScaling, StandardScaling
from tricolor.sources.readers import normalize_missing


def test_normalize_missing(spark):
    df = spark.createDataFrame([(float("nan"), "NA"), (1.0, "x"), (None, "")], "a double, s string")
    r = normalize_missing(df).collect()
    assert r[0]["a"] is None and r[0]["s"] is None and r[2]["s"] is None and r[1]["s"] == "x"


def test_missing_fit_and_replay(spark):
    train = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 5.0, "b")], "row_id long, x double, s string")
    test = spark.createDataFrame([(9, None, None)], "row_id long, x double, s string")
    steps = fit_missing(train, [MissingStep("mean", "x"), MissingStep("mean", "s"), MissingStep("zero", "s")])
    assert steps[0].value == 3.0 and len(steps) == 2          # mean on a string column is skipped
    r = apply_missing(test, steps).first()
    assert r["x"] == 3.0 and r["s"] == "0"                    # training mean replayed; "0" for strings
    med = fit_missing(train, [MissingStep("median", "x")])
    assert med[0].value == 3.0
    assert apply_missing(train, [MissingStep("drop_rows", "x")]).count() == 2
    assert "x" not in apply_missing(train, [MissingStep("drop_column", "x")]).columns


def test_label_checks(spark):
    one = spark.createDataFrame([(1,), (1,)], "y int")
    three = spark.createDataFrame([(1,), (2,), (3,)], "y int")
    with pytest.raises(lab.LabelError):
        lab.binary_values(one, "y")
    with pytest.raises(lab.LabelError):
        lab.binary_values(three, "y")
    df = spark.createDataFrame([("yes",), ("no",), ("maybe",)], "y string")
    with pytest.raises(lab.LabelError):
        lab.map_label(df, "y", "no", "yes")
    ok = lab.map_label(df.where("y != 'maybe'"), "y", "no", "yes").collect()
    assert sorted(r["y"] for r in ok) == [0, 1]
    dec = spark.createDataFrame([(0,), (1,), (7,)], "p int").select(lab.decode_label("p", {0: "no", 1: "yes"}))
    assert [r[0] for r in dec.collect()] == ["no", "yes", "7"]
    with pytest.raises(lab.LabelError):
        lab.check_test_labels(df, df.where("y = 'no'"), "y")


def test_onehot_drop_first_null_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "s string")
    enc = OneHotEncoding.fit(train, ["s"])
    assert enc.output_columns("s") == ["s_b", "s_c"]
    test = spark.createDataFrame([("a",), ("c",), ("zzz",), (None,)], "s string")
    r = [tuple(x) for x in enc.transform(test).collect()]
    assert r == [(0.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
    big = spark.range(50).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError):
        OneHotEncoding.fit(big, ["s"], max_categories=10)


def test_scalers_constant_and_zero_std(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "x double, c double")
    mm = MinMaxScaling.fit(df, ["x", "c"]).transform(df).collect()
    assert [(r["x"], r["c"]) for r in mm] == [(0.0, 0.0), (1.0, 0.0)]
    st = StandardScaling.fit(df, ["x", "c"]).transform(df).collect()
    assert [(r["x"], r["c"]) for r in st] == [(-1.0, 0.0), (1.0, 0.0)]   # population std


def test_finite_and_outliers_and_align(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.inf), (3, float("nan")), (4, None), (5, -math.inf)], "id int, x double")
    assert [r["id"] for r in drop_non_finite(df, ["x"]).collect()] == [1]
    vals = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    f = IqrFilter.fit(vals, "x")
    assert f.removed(vals).count() == 1 and f.keep(vals).count() == 5     # NULL kept
    a = align_to(spark.createDataFrame([(1, 2, 3)], "row_id int, b int, extra int"), ["a", "b"])
    assert a.columns == ["row_id", "a", "b"] and tuple(a.first()) == (1, 0.0, 2.0)
    with pytest.raises(MissingColumnsError):
        require_columns(a, ["zzz"])


def test_quantiles_match_percentile_and_split_hot_values(spark):
    from tricolor.operators import profile
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    df = spark.range(0, 997).select(((F.col("id") * 37) % 1000 / 7.0).alias("x"), F.when(F.col("id") % 5 > 0, 0.0).otherwise(
        F.col("id").cast("double")).alias("hot"), F.lit(None).cast("double").alias("none"), F.col("id").alias("k"))
    got = profile.quantile_table(df, ["x", "hot", "none", "k"], probs)
    for c in ("x", "hot", "k"):
        want = df.agg(F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs]))).first()[0]
        assert got[c] == pytest.approx(want, rel=1e-12)
    assert got["none"] == [None] * len(probs)
