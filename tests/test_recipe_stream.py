import pytest
from pyspark.sql import functions as F

from tricolor.operators.missing import MissingStep
from tricolor.operators.models.catalog import grid, model
from tricolor.operators.tune import candidates, search_cv
from tricolor.plans.recipe import Recipe
from tricolor.session import scratch_path
from tricolor.sources.readers import read_csv, read_json
from tricolor.sources.sinks import assemble_results, write_csv, write_json


def _train_test(spark):
    train = spark.createDataFrame(
        [(1, "yes", "a", 1.0, 10.0), (2, "no", "b", None, 20.0), (3, "yes", "c", 3.0, 30.0),
         (4, "no", "a", 5.0, 40.0), (5, "yes", "b", 7.0, 50.0), (6, "no", "c", 9.0, 60.0)],
        "row_id long, y string, cat string, x double, z double")
    test = spark.createDataFrame([(7, "no", "zzz", None, 35.0), (8, "maybe", "b", 2.0, 15.0), (9, None, "a", 4.0, 25.0)],
                                 "row_id long, y string, cat string, x double, z double")
    return train, test


def test_recipe_fits_on_train_and_replays_on_test(spark):
    train, test = _train_test(spark)
    r = Recipe("y")
    t = r.fit_base(train, "no", "yes", missing=[MissingStep("mean", "x")], categorical=["cat"])
    assert r.features == ["cat_b", "cat_c", "x", "z"]
    t = r.standard(t, ["z"])
    t = r.feature(t, "Multiply", "x", "z", "xz")
    t = r.drop(t, ["cat_c"])
    out = {row["row_id"]: row for row in r.apply(test).collect()}
    assert set(out) == {7}                       # 'maybe' and NULL targets do not map on test
    row = out[7]
    assert row["x"] == pytest.approx(5.0)        # training mean of x (1, 3, 5, 7, 9)
    assert row["cat_b"] == 0.0 and "cat_c" not in r.apply(test).columns   # unseen category -> zeros
    mean_z, std_z = 35.0, (sum((v - 35.0) ** 2 for v in (10, 20, 30, 40, 50, 60)) / 6) ** 0.5
    assert row["z"] == pytest.approx(0.0) and row["xz"] == pytest.approx(0.0)
    unlabelled = r.apply(test.drop("y"), with_label=False)
    assert unlabelled.count() == 3
    steps = [x["kind"] for x in r.describe(spark).collect()]
    assert steps[-3:] == ["standard", "feature", "drop"] and mean_z and std_z


def test_random_search_is_seeded_subset():
    g = grid("Ridge")
    a, b = candidates(g, "random", 4), candidates(g, "random", 4)
    assert a == b and len(a) == 4 and all(c in g for c in a)
    assert candidates(g, "grid") == g


def test_search_cv_picks_a_candidate(spark):
    rows = [(i + 1, float(i % 10), float((i * 3) % 7), 1 if i % 10 > 5 else 0) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y long")
    best, results, fitted = search_cv(model("NB"), grid("NB"), df, ["a", "b"], "y", k=3)
    assert len(results) == 5 and best in [c for c, _ in results]
    assert all(0.5 <= s <= 1.0 for _, s in results)
    assert fitted.predict(df).count() == 120


def test_assemble_results_skips_absent(spark):
    df = spark.createDataFrame([(1, 2.0, 0, 0.2, "Green")], "row_id long, f double, M_Prediction int, M_Prob double, M_TrafficLight string")
    out = assemble_results(df, "row_id", ["f", "nope"], ["f"], ["PC1"], ["M", "Other"])
    assert out.columns == ["row_id", "f", "TF_f", "M_Prediction", "M_Prob", "M_TrafficLight"]


def test_csv_json_round_trip(spark):
    df = spark.createDataFrame([(1, "NA", 1.5), (2, "x", None)], "k long, s string, v double")
    back = read_csv(spark, write_csv(df, scratch_path(spark, "t_csv")), schema=df.schema).orderBy("k").collect()
    assert back[0]["s"] is None and back[1]["v"] is None and back[0]["v"] == 1.5
    j = read_json(spark, write_json(df, scratch_path(spark, "t_json")), schema=df.schema)
    assert j.columns == ["k", "s", "v"] and j.count() == 2


def test_stream_scoring_equals_batch(spark):
    from tricolor.streaming.score_stream import score_files, score_stream
    train, test = _train_test(spark)
    r = Recipe("y")
    t = r.fit_base(train, "no", "yes", missing=[MissingStep("mean", "x")], categorical=["cat"])
    nb = model("NB").fit(t, r.features, "y")
    streamed = {x["row_id"]: x["NB_Prob"] for x in score_files(spark, test.drop("y"), r, [nb]).collect()}
    batch = {x["row_id"]: x["NB_Prob"] for x in score_stream(test.drop("y"), r, [nb]).collect()}
    assert streamed == pytest.approx(batch) and len(streamed) == 3
    with pytest.raises(ValueError):
        score_stream(test, r, [model("KNN").fit(t, r.features, "y")])
    assert F is not None


def test_sample_catalog_paths_and_load(spark):
    from tricolor.session import checkpoint_dir
    from tricolor.sources.readers import SampleCatalog
    base = scratch_path(spark, "catalog")
    cat = SampleCatalog(base)
    assert cat.path("diabetes", "csv", "test").endswith("/csv/diabetes test.csv")
    df = spark.createDataFrame([(1, 148.0, 1), (0, 85.0, 0)], "Pregnancies int, Glucose double, Outcome int")
    write_csv(df, cat.path("diabetes", "csv", "train"))
    assert cat.load(spark, "diabetes", "csv", "train", schema=df.schema).count() == 2
    with pytest.raises(ValueError):
        cat.path("unknown")
    with pytest.raises(ValueError):
        cat.load(spark, "titanic", "xlsx", "test")
    assert checkpoint_dir(spark)


def test_json_array_file(spark, tmp_path):
    import json as _json
    p = tmp_path / "banknote test.json"
    rows = [{"Variance": 3.6, "Skewness": 8.6, "Curtosis": -2.8, "Entropy": -0.4, "Class": 0},
            {"Variance": -1.4, "Skewness": -4.9, "Curtosis": 6.5, "Entropy": 0.4, "Class": 1}]
    p.write_text(_json.dumps(rows))
    df = read_json(spark, str(p), multiline=True, columns=["Variance", "Skewness", "Curtosis", "Entropy", "Class"])
    assert df.columns == ["Variance", "Skewness", "Curtosis", "Entropy", "Class"] and df.count() == 2


def test_recipe_refuses_unmapped_training_target(spark):
    from tricolor.operators.labels import LabelError
    train, _ = _train_test(spark)
    bad = train.union(spark.createDataFrame([(99, "maybe", "a", 1.0, 1.0)], train.schema))
    with pytest.raises(LabelError):
        Recipe("y").fit_base(bad, "no", "yes", categorical=["cat"])
    with pytest.raises(LabelError):
        Recipe("y").fit_base(bad, "no", "yes", categorical=[])
