import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tricolor.functions.hashing import hash_key
from tricolor.operators import cutoff as ct
from tricolor.operators import sampling as smp


def md5_order(seed, ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("small", [2000, 3, 1])
def test_split_takes_the_first_rows_in_md5_order(spark, monkeypatch, small):
    monkeypatch.setattr(ct, "SORTED_ROWS", small)
    ids = random.Random(1).sample(range(10**9), 700)
    df = spark.createDataFrame([(i, "payload") for i in ids], "row_id long, is_payload string")
    for share in (0.001, 0.2, 0.5, 0.999):
        out = smp.split_train_val(df, share, seed=9)
        assert {r.row_id for r in out.where("is_val").collect()} == set(md5_order(9, ids)[:math.ceil(700 * share)])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort", "Window", "ExistingRDD[_"))


@pytest.mark.parametrize("small", [2000, 2])
def test_under_sampling_by_class_cutoffs(spark, monkeypatch, small):
    monkeypatch.setattr(ct, "SORTED_ROWS", small)
    rng = random.Random(2)
    rows = [(i, rng.choices([0, 1, 2, None], [60, 25, 10, 5])[0]) for i in range(900)]
    out = smp.under_sample(spark.createDataFrame(rows, "row_id long, y long"), "y", seed=4)
    classes = {c: [i for i, x in rows if x == c] for c in (0, 1, 2, None)}
    least = min(map(len, classes.values()))
    got = {}
    for r in out.collect():
        got.setdefault(r.y, set()).add(r.row_id)
    assert got == {c: set(md5_order(4, ids)[:least]) for c, ids in classes.items()}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_cutoffs_of_nothing_and_of_everything(spark):
    empty = spark.createDataFrame([], "row_id long, y long")
    assert smp.split_train_val(empty, 0.2).collect() == [] and smp.under_sample(empty, "y").collect() == []
    df = spark.range(50).withColumnRenamed("id", "row_id")
    key = hash_key(1, F.col("row_id"))
    for n, want in ((0, 0), (1, 1), (50, 50)):
        total, cut = ct.cutoff(df, key, F.col("row_id"), lambda _, n=n: n)
        assert total == 50 and df.where(cut.holds(key, F.col("row_id"))).count() == want
    with pytest.raises(ValueError):
        ct.cutoff(df, key, F.col("row_id"), lambda n: n + 1)


def test_equal_keys_are_cut_by_id(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), F.md5(F.lit("same")).alias("k"))
    _, cut = ct.cutoff(df, F.col("k"), F.col("row_id"), lambda n: 7)
    assert {r.row_id for r in df.where(cut.holds(F.col("k"), F.col("row_id"))).collect()} == set(range(7))
