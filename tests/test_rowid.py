from pyspark.sql import functions as F

from tricolor.sources.rowid import add_row_id, ordered_rank, ordered_running_sum, rank_within


def test_ordered_rank_is_exact_global_rank(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    r = ordered_rank(df, [F.col("k")], "rk", num_partitions=7).collect()
    pairs = sorted((row["k"], row["rk"]) for row in r)
    assert [p[1] for p in pairs] == list(range(1, 5001))


def test_add_row_id_keeps_existing_and_orders_by_key(spark):
    df = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "k long, v string")
    out = {r["v"]: r["row_id"] for r in add_row_id(df, ["k"]).collect()}
    assert out == {"a": 1, "b": 2, "c": 3}
    again = add_row_id(add_row_id(df, ["k"]), ["v"])
    assert again.columns.count("row_id") == 1


def test_rank_within_groups(spark):
    df = spark.createDataFrame([(g, i) for g in (0, 1) for i in range(50 + 25 * g)], "g int, i int")
    r = rank_within(df, "g", [F.col("i")], "rk", num_partitions=5).collect()
    for g, n in ((0, 50), (1, 75)):
        ranks = sorted(x["rk"] for x in r if x["g"] == g)
        assert ranks == list(range(1, n + 1))


def test_running_sum(spark):
    df = spark.range(1, 101).select(F.col("id").alias("k"), F.lit(2).alias("w"))
    r = ordered_running_sum(df, [F.col("k")], ["w"], num_partitions=4).collect()
    assert all(x["cum_w"] == 2 * x["k"] for x in r)


def test_narrow_key_ranking_equals_full(spark):
    from tricolor.functions.hashing import hash_key
    from tricolor.operators.sampling import split_train_val
    df = spark.range(1, 501).select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("a"),
                                    F.lit("wide payload").alias("b"))
    full = {r["row_id"]: r["rk"] for r in ordered_rank(df, [hash_key(7, F.col("row_id")), F.col("row_id")], "rk").collect()}
    narrow = {r["row_id"]: r["rk"] for r in ordered_rank(df, [hash_key(7, F.col("row_id")), F.col("row_id")], "rk",
                                                         key_cols=["row_id"]).collect()}
    assert full == narrow and sorted(full.values()) == list(range(1, 501))
    a = {r["row_id"]: r["is_val"] for r in split_train_val(df, 0.3).collect()}
    assert sum(a.values()) == 150
    ids = add_row_id(df.drop("row_id"), ["a"], narrow=True)
    assert ids.columns[0] == "row_id" and ids.agg(F.max("row_id")).first()[0] == 500


def test_offsets_of_many_partitions_are_a_small_relation(spark):
    import time

    from tricolor.sources.rowid import partition_offsets
    totals = spark.range(20_000).selectExpr("cast(id as int) as _tc_pid", "id % 7 as n")
    t = time.time()
    got = {r["_tc_pid"]: r["_tc_off_n"] for r in partition_offsets(totals, ["n"]).collect()}
    assert time.time() - t < 30
    run = 0
    for i in range(20_000):
        assert got[i] == run
        run += i % 7


def test_ship_package_zip(spark):
    import glob
    import os
    import tempfile
    import zipfile

    from tricolor import session
    session._SHIPPED.discard(spark.sparkContext.applicationId)
    session.ship_package(spark)
    assert spark.sparkContext.applicationId in session._SHIPPED
    zips = glob.glob(os.path.join(tempfile.gettempdir(), "tricolor-pyfiles-*", "tricolor.zip"))
    newest = max(zips, key=os.path.getmtime)
    assert "tricolor/operators/neighbors.py" in zipfile.ZipFile(newest).namelist()


def test_rank_property_random_keys(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.tuples(st.integers(-5, 5), st.text(max_size=3)), min_size=1, max_size=60, unique=True))
    def check(keys):
        df = spark.createDataFrame(keys, "a int, b string")
        got = sorted((r["rk"], r["a"], r["b"]) for r in ordered_rank(df, [F.col("a"), F.col("b")], "rk").collect())
        want = sorted(keys, key=lambda t: (t[0], t[1].encode("utf-8")))
        assert [(a, b) for _, a, b in got] == want and [g[0] for g in got] == list(range(1, len(keys) + 1))

    check()
