import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_contract_keys():
    m = _entry()
    qs, sqls = m.queries(), m.oracle_sql()
    assert len(qs) >= 100
    assert set(sqls) <= set(qs)
    assert all(callable(f) for f in qs.values())


def test_entry_runs(spark, sf_small):
    df = _entry().entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "accuracy", "precision", "recall", "f1", "auc"]
    assert len(rows) == 1 and rows[0]["model"] == "Ridge"


def test_learnable_task_training_auc(spark, sf_small):
    from tricolor.operators.metrics import auc
    from tricolor.operators.models.catalog import model
    from tricolor.plans.workflow import prepared_task
    p = prepared_task(spark, sf_small)
    fitted = model("Ridge").fit(p.train, p.features, "quality")
    assert auc(fitted.predict(p.train), "quality", "Ridge_Prob").first()["auc"] >= 0.9
