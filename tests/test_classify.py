import pytest
from pyspark.sql import functions as F

from tricolor.operators.columns import MissingColumnsError
from tricolor.operators.labels import LabelError
from tricolor.plans.classify import score, train
from tricolor.sources import fixtures as fx


def test_train_and_score_any_table(spark, sf_small):
    df = fx.docs_nulls(spark, sf_small).drop("row_id", "toxic", "source")
    labelled = df.where(F.col("quality").isNotNull())
    run = train(labelled, "quality", 0, 1, ["Ridge", "NB"], key_cols=["doc_id"], categorical=["lang"],
                resample="under", pca_k=None)
    v = {r["model"]: r for r in run.validation.collect()}
    assert set(v) == {"Ridge", "NB"} and all(0.0 <= r["accuracy"] <= 1.0 for r in v.values())
    out = score(run, df.drop("quality"), key_cols=["doc_id"], flips={"NB": True})
    cols = out.results.columns
    assert cols[0] == "row_id" and "TF_n_chars" in cols and "NB_TrafficLight" in cols
    assert out.metrics is None
    assert out.results.count() == df.count()
    with_target = score(run, labelled, key_cols=["doc_id"])
    assert with_target.metrics.count() == 2
    run.release()
    assert run.persisted == []


def test_train_with_pca_and_smote(spark, sf_small):
    df = fx.docs_task(spark, sf_small).drop("row_id", "source")
    run = train(df, "quality", 0, 1, ["NB"], key_cols=["doc_id"], categorical=["lang"], resample="smote",
                pca_k=2, scaling="minmax", outlier_columns=["n_chars"])
    assert run.features == ["PC1", "PC2"]
    counts = {r["quality"]: r["count"] for r in run.train.groupBy("quality").count().collect()}
    assert counts[0] == counts[1]
    out = score(run, df, key_cols=["doc_id"])
    assert "PC1" in out.results.columns and out.metrics.count() == 1


def _toy(spark, n=200):
    rows = [(i, float(i % 11), float((i * 7) % 5), "yes" if i % 11 > 5 else "no", "u" if i % 3 else "w") for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, y string, c string")


def test_scoring_refuses_what_it_cannot_score(spark):
    df = _toy(spark)
    run = train(df, "y", "no", "yes", ["NB"], key_cols=["k"], derived=[("Add", "a", "b")], drop=["b"])
    assert "k" not in run.features and run.recipe.required == ["a", "b", "c"] and "b" not in run.features
    with pytest.raises(MissingColumnsError, match="a"):
        score(run, df.drop("a"), key_cols=["k"])
    with pytest.raises(LabelError, match="maybe"):
        score(run, df.withColumn("y", F.when(F.col("k") < 100, "maybe").otherwise(F.col("y"))), key_cols=["k"])
    holes = df.withColumn("y", F.when(F.col("k") >= 10, F.col("y"))).withColumn(
        "a", F.when(F.col("k") == 50, float("inf")).when(F.col("k") != 60, F.col("a")))
    out = score(run, holes, key_cols=["k"])
    assert out.without_target == 10 and out.removed_rows == 2 and out.results.count() == 188
    # the derived feature is the same whether or not its source was dropped after it
    got = {r["k"]: r["TF_" + run.features[-1]] for r in score(run, df, key_cols=["k"]).results.collect()}
    assert len(set(got.values())) > 5


def test_synthetic_ids_and_removed_outliers(spark):
    df = _toy(spark).withColumn("a", F.when(F.col("k") == 7, 500.0).otherwise(F.col("a"))).where("y = 'no' or k % 5 = 0")
    run = train(df, "y", "no", "yes", ["NB"], key_cols=["k"], scaling=None, outlier_columns=["a"], resample="over")
    ids = [r["row_id"] for r in run.train.select("row_id").unionByName(run.val.select("row_id")).collect()]
    assert len(ids) == len(set(ids)) and "is_synthetic" in run.train.columns
    assert run.outliers.count() <= 1 and "resample" in {r["kind"] for r in run.recipe.describe(spark).collect()}


def test_a_model_that_cannot_score_is_skipped_and_named(spark):
    df = _toy(spark)
    run = train(df, "y", "no", "yes", ["NB", "PLSDA"], key_cols=["k"])
    assert score(run, df, key_cols=["k"]).skipped.count() == 0
    run.models[0].features = ["not there"] * len(run.models[0].features)
    out = score(run, df, key_cols=["k"])
    assert [r["model"] for r in out.skipped.collect()] == ["NB"] and out.results.count() == 200
    assert "PLSDA_Prob" in out.results.columns and "NB_Prob" not in out.results.columns
    assert [r["model"] for r in out.metrics.collect()] == ["PLSDA"]
    run.models[1].features = ["not there"] * len(run.models[1].features)
    with pytest.raises(ValueError, match="NB"):
        score(run, df, key_cols=["k"])
