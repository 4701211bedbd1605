"""Queries for sources/sinks, projections, filters, missing values, labels, encoding, joins,
profiling aggregates, windows, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tricolor.functions import scalar as fn
from tricolor.functions.hashing import sql_hash_key
from tricolor.operators import columns as cols
from tricolor.operators import labels as lab
from tricolor.operators import profile as prof
from tricolor.operators.encode import OneHotEncoding, sparse_onehot
from tricolor.operators import joins
from tricolor.operators.missing import MissingStep, apply_missing, fit_missing
from tricolor.operators.sampling import split_train_val
from tricolor.plans.registry import query
from tricolor.session import scratch_path
from tricolor.sources import fixtures as fx
from tricolor.sources.readers import TableCatalog, read_csv, read_json, table
from tricolor.sources.rowid import add_row_id
from tricolor.sources.sinks import assemble_results, head, write_csv, write_json, write_json_arrays

SPLIT_SQL = f"""
(SELECT *, row_number() OVER (ORDER BY {sql_hash_key(42, 'row_id')}, row_id)
           <= ceil(count(*) OVER () * 0.2) AS is_val FROM ({{src}}))"""


def split_sql(src: str) -> str:
    return SPLIT_SQL.format(src=src)


# --- 2.1 sources and sinks -------------------------------------------------------------

@query("src_csv", "SELECT * FROM customer")
def src_csv(spark, d):
    """customer written as headed CSV and read back with its declared schema."""
    cust = table(spark, d, "customer")
    path = write_csv(cust, scratch_path(spark, "src_csv"))
    return read_csv(spark, path, schema=cust.schema)


@query("src_json", "SELECT * FROM part")
def src_json(spark, d):
    """part written as JSON Lines and read back; declared column order restored."""
    part = table(spark, d, "part")
    path = write_json(part, scratch_path(spark, "src_json"))
    return read_json(spark, path, schema=part.schema)


@query("src_json_array", "SELECT * FROM customer")
def src_json_array(spark, d):
    """customer written as arrays of records and read back by byte ranges."""
    customer = table(spark, d, "customer")
    path = write_json_arrays(customer, scratch_path(spark, "src_json_array"))
    return read_json(spark, path, schema=customer.schema, multiline=True)


@query("src_catalog", "SELECT * FROM nation")
def src_catalog(spark, d):
    return TableCatalog(d).load(spark, "nation")


def _orders(spark, d):
    """All of ``orders``; the order date, which has no time of day, as text."""
    return table(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("src_rowid", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS row_id, o_orderkey, o_custkey, o_orderstatus,
       o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def src_rowid(spark, d):
    return add_row_id(_orders(spark, d), ["o_orderkey"], persist_input=False)


@query("snk_csv", "SELECT * FROM supplier")
def snk_csv(spark, d):
    """Export as headed CSV (no index); round trip must give the table back."""
    s = table(spark, d, "supplier")
    path = write_csv(s, scratch_path(spark, "snk_csv"))
    return read_csv(spark, path, schema=s.schema)


@query("snk_json", "SELECT * FROM region")
def snk_json(spark, d):
    r = table(spark, d, "region")
    path = write_json(r, scratch_path(spark, "snk_json"))
    return read_json(spark, path, schema=r.schema)


@query("snk_results", f"""
SELECT row_id, doc_id, lang, source, round(ln(1 + n_chars), 6) AS TF_n_chars_log,
       pred AS MD5_Prediction, score AS MD5_Prob,
       CASE WHEN pred = 0 AND 1 - score >= 0.85 THEN 'Green'
            WHEN pred = 1 AND score >= 0.85 THEN 'Red' ELSE 'Yellow' END AS MD5_TrafficLight
FROM ({fx.SQL_SCORED})""")
def snk_results(spark, d):
    s = fx.scored(spark, d)
    s = s.select("*", fn.fn_log("n_chars").alias("n_chars_log"),
                 F.col("pred").alias("MD5_Prediction"), F.col("score").alias("MD5_Prob"),
                 fn.fn_traffic("pred", "score").alias("MD5_TrafficLight"))
    return assemble_results(s, "row_id", ["doc_id", "lang", "source"], ["n_chars_log"], ["PC1"],
                            ["MD5", "GBM"])


@query("src_preview", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS row_id, o_orderkey, o_custkey, o_orderstatus,
       o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5""")
def src_preview(spark, d):
    o = add_row_id(_orders(spark, d), ["o_orderkey"], persist_input=False)
    return head(o, 5)


# --- 2.2 projections and filters -------------------------------------------------------

@query("prj_select", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
def prj_select(spark, d):
    return cols.select_columns(table(spark, d, "customer"), ["c_mktsegment", "c_custkey", "c_acctbal"])


@query("prj_drop", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_returnflag, l_linestatus FROM lineitem""")
def prj_drop(spark, d):
    return cols.drop_columns(table(spark, d, "lineitem"), ["l_discount", "l_tax", "l_shipdate", "absent"])


@query("prj_split_xy", f"""
SELECT row_id, doc_id, lang, source, n_chars, nonletter_share, word_share, quality
FROM ({fx.SQL_DOCS_TASK})""")
def prj_split_xy(spark, d):
    _, out = cols.split_xy(fx.docs_task(spark, d), "quality")
    return out


@query("prj_dtype", """
SELECT column_name AS "column",
       CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
            WHEN column_type = 'VARCHAR' THEN 'string' ELSE 'other' END AS kind
FROM (DESCRIBE customer)""")
def prj_dtype(spark, d):
    return cols.column_kinds(table(spark, d, "customer"))


@query("prj_require", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def prj_require(spark, d):
    o = cols.require_columns(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return o.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("prj_reindex", "SELECT c_custkey, c_acctbal, 0 AS c_phone FROM customer")
def prj_reindex(spark, d):
    return cols.reindex(table(spark, d, "customer"), ["c_custkey", "c_acctbal", "c_phone"], 0)


@query("prj_align", """
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_O,
       CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_P,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_2-HIGH",
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_3-MEDIUM",
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_4-NOT SPECIFIED",
       CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_5-LOW",
       0.0::DOUBLE AS o_shippriority
FROM orders""")
def prj_align(spark, d):
    """Encode with the fitted categories, then force to the training feature list:
    the absent ``o_shippriority`` is added as 0.0, the extra ``o_custkey`` and ``o_orderdate`` dropped."""
    o = table(spark, d, "orders")
    enc = OneHotEncoding.fit(o, ["o_orderstatus", "o_orderpriority"])
    feats = ["o_totalprice"] + enc.output_columns("o_orderstatus") + enc.output_columns("o_orderpriority") \
        + ["o_shippriority"]
    return cols.align_to(enc.transform(o), feats, keep=["o_orderkey"])


@query("prj_cast", f"""
SELECT row_id, n_chars, nonletter_share, word_share, CAST(quality AS BIGINT) AS quality
FROM ({fx.SQL_DOCS_TASK})""")
def prj_cast(spark, d):
    t = fx.docs_task(spark, d).select("row_id", "n_chars", "nonletter_share", "word_share",
                                      F.col("quality").cast("int").alias("quality"))
    return cols.cast_features(t, fx.FEATURES, "quality")


@query("prj_rename", f"""
SELECT row_id, n_chars AS TF_n_chars, nonletter_share AS TF_nonletter_share,
       word_share AS TF_word_share, quality FROM ({fx.SQL_DOCS_TASK})""")
def prj_rename(spark, d):
    t = fx.docs_task(spark, d).select("row_id", *fx.FEATURES, "quality")
    return cols.prefix_columns(t, "TF_", fx.FEATURES)


@query("flt_target", f"SELECT * FROM ({fx.SQL_DOCS_TASK}) WHERE quality = 1")
def flt_target(spark, d):
    return cols.filter_target(fx.docs_task(spark, d), "quality", 1)


@query("flt_category", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def flt_category(spark, d):
    return cols.filter_category(table(spark, d, "customer"), "c_mktsegment", "BUILDING")


@query("flt_notnull", f"SELECT * FROM ({fx.SQL_DOCS_NULLS}) WHERE quality IS NOT NULL")
def flt_notnull(spark, d):
    return cols.drop_null_rows(fx.docs_nulls(spark, d), ["quality"])


@query("flt_finite", """
SELECT c_custkey, c_acctbal, round(ln(1 + c_acctbal), 6) AS acct_log
FROM customer WHERE c_acctbal > -1""")
def flt_finite(spark, d):
    """log1p of a balance is non-finite for balance <= -1; those rows are dropped."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", fn.fn_log("c_acctbal").alias("acct_log"))
    return cols.drop_non_finite(c, ["c_acctbal", "acct_log"])


IQR_SQL = """(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
        quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
        quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi
        FROM events)"""


@query("flt_outlier_iqr", f"""
SELECT e.event_id, e.event_type, e.value FROM events e, {IQR_SQL} f
WHERE NOT (e.value < f.lo OR e.value > f.hi)""")
def flt_outlier_iqr(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return cols.IqrFilter.fit(e, "value").keep(e)


MISSING_SQL = f"""
SELECT col AS "column", CAST(missing AS BIGINT) AS missing,
       round(missing * 100.0 / n, 2) AS pct_missing
FROM (SELECT count(*) AS n,
             count(*) FILTER (WHERE row_id IS NULL) AS m_row_id,
             count(*) FILTER (WHERE doc_id IS NULL) AS m_doc_id,
             count(*) FILTER (WHERE lang IS NULL) AS m_lang,
             count(*) FILTER (WHERE source IS NULL) AS m_source,
             count(*) FILTER (WHERE n_chars IS NULL) AS m_n_chars,
             count(*) FILTER (WHERE nonletter_share IS NULL) AS m_nonletter_share,
             count(*) FILTER (WHERE word_share IS NULL) AS m_word_share,
             count(*) FILTER (WHERE quality IS NULL) AS m_quality,
             count(*) FILTER (WHERE toxic IS NULL) AS m_toxic
      FROM ({fx.SQL_DOCS_NULLS}))
UNPIVOT (missing FOR col IN (m_row_id AS 'row_id', m_doc_id AS 'doc_id', m_lang AS 'lang',
         m_source AS 'source', m_n_chars AS 'n_chars', m_nonletter_share AS 'nonletter_share',
         m_word_share AS 'word_share', m_quality AS 'quality', m_toxic AS 'toxic'))"""


@query("flt_hasnull", f"SELECT * FROM ({MISSING_SQL}) WHERE missing > 0")
def flt_hasnull(spark, d):
    return prof.missing_counts(fx.docs_nulls(spark, d)).where(F.col("missing") > 0)


# --- 2.3 missing values ----------------------------------------------------------------

@query("mis_drop_rows", f"SELECT * FROM ({fx.SQL_DOCS_NULLS}) WHERE quality IS NOT NULL")
def mis_drop_rows(spark, d):
    return apply_missing(fx.docs_nulls(spark, d), [MissingStep("drop_rows", "quality")])


@query("mis_drop_cols", f"SELECT * EXCLUDE (toxic) FROM ({fx.SQL_DOCS_NULLS})")
def mis_drop_cols(spark, d):
    return apply_missing(fx.docs_nulls(spark, d), [MissingStep("drop_column", "toxic")])


@query("mis_zero", f"""
SELECT * REPLACE (coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic)
FROM ({fx.SQL_DOCS_NULLS})""")
def mis_zero(spark, d):
    return apply_missing(fx.docs_nulls(spark, d), [MissingStep("zero", "quality"), MissingStep("zero", "toxic")])


@query("mis_mean", f"""
SELECT * REPLACE (round(coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM ({fx.SQL_DOCS_NULLS}))), 6)
                  AS quality)
FROM ({fx.SQL_DOCS_NULLS})""")
def mis_mean(spark, d):
    dn = fx.docs_nulls(spark, d)
    steps = fit_missing(dn, [MissingStep("mean", "quality"), MissingStep("mean", "lang")])
    return apply_missing(dn, steps)


@query("mis_median", f"""
SELECT * REPLACE (coalesce(CAST(toxic AS DOUBLE), (SELECT median(toxic) FROM ({fx.SQL_DOCS_NULLS}))) AS toxic)
FROM ({fx.SQL_DOCS_NULLS})""")
def mis_median(spark, d):
    dn = fx.docs_nulls(spark, d)
    return apply_missing(dn, fit_missing(dn, [MissingStep("median", "toxic")]))


@query("mis_replay", f"""
WITH s AS {split_sql(fx.SQL_DOCS_NULLS)},
     m AS (SELECT avg(quality) AS mq, median(toxic) AS mt FROM s WHERE NOT is_val)
SELECT s.* EXCLUDE (is_val, quality, toxic),
       round(coalesce(CAST(s.quality AS DOUBLE), m.mq), 6) AS quality,
       coalesce(CAST(s.toxic AS DOUBLE), m.mt) AS toxic
FROM s, m WHERE s.is_val""")
def mis_replay(spark, d):
    """Fill values fitted on the training part, replayed unchanged on the validation part."""
    s = split_train_val(fx.docs_nulls(spark, d), 0.2)
    train, val = s.where(~F.col("is_val")), s.where(F.col("is_val")).drop("is_val")
    steps = fit_missing(train, [MissingStep("mean", "quality"), MissingStep("median", "toxic")])
    return apply_missing(val, steps)


# --- 2.4 labels and encoding -----------------------------------------------------------

@query("lbl_check", "SELECT DISTINCT l_linestatus AS value FROM lineitem")
def lbl_check(spark, d):
    li = table(spark, d, "lineitem")
    vals = lab.binary_values(li, "l_linestatus")
    return li.select(F.col("l_linestatus").alias("value")).where(F.col("value").isin(vals)).distinct()


@query("lbl_map", """
SELECT l_orderkey, l_linenumber, CAST(CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS BIGINT) AS label
FROM lineitem""")
def lbl_map(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return lab.map_label(li, "l_linestatus", "F", "O", out="label").select("l_orderkey", "l_linenumber", "label")


@query("lbl_factorize", """
SELECT value, CAST(row_number() OVER (ORDER BY first_key) - 1 AS BIGINT) AS code
FROM (SELECT o_orderstatus AS value, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus)""")
def lbl_factorize(spark, d):
    return lab.factorize_codes(table(spark, d, "orders"), "o_orderstatus", "o_orderkey")


@query("lbl_sorted", """
SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT c_mktsegment AS value FROM customer)""")
def lbl_sorted(spark, d):
    return lab.sorted_codes(table(spark, d, "customer"), "c_mktsegment")


@query("lbl_decode", f"""
SELECT row_id, CASE pred WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE CAST(pred AS VARCHAR) END AS pred_label
FROM ({fx.SQL_SCORED})""")
def lbl_decode(spark, d):
    s = fx.scored(spark, d)
    return s.select("row_id", lab.decode_label("pred", {0: "low", 1: "high"}).alias("pred_label"))


@query("lbl_test_check", """
(SELECT l_returnflag AS value, 'train_only' AS side FROM lineitem
 EXCEPT SELECT l_returnflag, 'train_only' FROM lineitem WHERE l_returnflag <> 'A')""")
def lbl_test_check(spark, d):
    """Label-set comparison of a training and a test table; the differing values and side."""
    li = table(spark, d, "lineitem")
    return lab.label_set_diff(li, li.where(F.col("l_returnflag") != "A"), "l_returnflag")


@query("lbl_test_encode", f"""
SELECT row_id, doc_id, CAST(CASE toxic WHEN 0 THEN 0 WHEN 1 THEN 1 END AS BIGINT) AS toxic
FROM ({fx.SQL_DOCS_NULLS}) WHERE toxic IN (0, 1)""")
def lbl_test_encode(spark, d):
    dn = fx.docs_nulls(spark, d).select("row_id", "doc_id", "toxic")
    return lab.encode_test_label(dn, "toxic", 0, 1)


@query("lbl_distribution", """
SELECT quality AS class, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
FROM labels GROUP BY quality""")
def lbl_distribution(spark, d):
    return lab.class_distribution(table(spark, d, "labels"), "quality")


@query("enc_onehot", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_BUILDING,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_FURNITURE,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_HOUSEHOLD,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_MACHINERY
FROM customer""", headline=True)
def enc_onehot(spark, d):
    c = table(spark, d, "customer")
    enc = OneHotEncoding.fit(c, ["c_mktsegment"])
    return enc.transform(c)


@query("enc_onehot_sparse", """
WITH l AS (SELECT c_custkey, 'c_mktsegment' AS col, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, 'c_name', c_name FROM customer),
k AS (SELECT col, v, row_number() OVER (ORDER BY col, v) - 1 AS p
      FROM (SELECT DISTINCT col, v, min(v) OVER (PARTITION BY col) AS first FROM l WHERE v IS NOT NULL) WHERE v <> first)
SELECT c_custkey, coalesce(string_agg(p::VARCHAR, ',' ORDER BY p), '') AS active FROM l LEFT JOIN k USING (col, v) GROUP BY c_custkey""")
def enc_onehot_sparse(spark, d):
    """One-hot of a column with a category per row: sorted positions instead of dummy columns."""
    _, rows = sparse_onehot(table(spark, d, "customer"), ["c_mktsegment", "c_name"], "c_custkey")
    return rows.select("c_custkey", F.array_join(F.transform("active", lambda x: x.cast("string")), ",").alias("active"))


# --- 2.5 joins -------------------------------------------------------------------------

@query("join_inner_align", f"""
SELECT x.row_id, x.n_chars, x.nonletter_share, x.word_share, y.quality
FROM ({fx.SQL_DOCS_NULLS}) x JOIN ({fx.SQL_DOCS_NULLS}) y ON x.row_id = y.row_id
WHERE y.quality IS NOT NULL""")
def join_inner_align(spark, d):
    dn = fx.docs_nulls(spark, d)
    x = dn.select("row_id", *fx.FEATURES)
    y = dn.select("row_id", "quality").where(F.col("quality").isNotNull())
    return joins.inner_align(x, y)


@query("join_semi", f"""
SELECT * FROM ({fx.SQL_DOCS_FEATURES}) f WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id)""")
def join_semi(spark, d):
    return joins.keep_surviving(fx.docs_features(spark, d), table(spark, d, "labels"), "doc_id")


@query("join_anti", f"""
SELECT e.event_id, e.event_type, e.value FROM events e, {IQR_SQL} f WHERE e.value < f.lo OR e.value > f.hi""")
def join_anti(spark, d):
    """Removed outlier rows = all rows minus the kept ones (anti join on the id)."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    kept = cols.IqrFilter.fit(e, "value").keep(e)
    return joins.removed_rows(e, kept, "event_id")


@query("join_concat", f"""
SELECT a.row_id, a.n_chars, a.nonletter_share, a.word_share, b.pred, b.score
FROM ({fx.SQL_SCORED}) a LEFT JOIN ({fx.SQL_SCORED}) b ON a.row_id = b.row_id""")
def join_concat(spark, d):
    s = fx.scored(spark, d)
    return joins.concat_by_id([s.select("row_id", *fx.FEATURES), s.select("row_id", "pred", "score")])


@query("join_lookup", """
SELECT c.c_custkey, c.c_nationkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup_join(c, n, "c_nationkey")


# --- 2.6 aggregates and profiling ------------------------------------------------------

@query("agg_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def agg_shape(spark, d):
    return prof.shape(table(spark, d, "lineitem"))


DTYPES_SQL = """
SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name AS "column",
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS dtype
FROM (DESCRIBE orders)"""


@query("agg_dtypes", DTYPES_SQL)
def agg_dtypes(spark, d):
    return prof.dtypes(table(spark, d, "orders"))


@query("agg_dtype_freq", f"SELECT dtype, count(*) AS n_columns FROM ({DTYPES_SQL}) GROUP BY dtype")
def agg_dtype_freq(spark, d):
    return prof.dtype_freq(table(spark, d, "orders"))


@query("agg_missing", f"SELECT * FROM ({MISSING_SQL}) WHERE missing > 0", headline=True)
def agg_missing(spark, d):
    return prof.missing_profile(fx.docs_nulls(spark, d))


@query("agg_value_counts", """
SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL
GROUP BY o_orderpriority""")
def agg_value_counts(spark, d):
    return prof.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("agg_describe", """
SELECT 'value' AS "column", count(value) AS count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, min(value) AS min,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max,
       round(quantile_cont(value, 0.5), 6) AS median
FROM events""", headline=True)
def agg_describe(spark, d):
    return prof.describe(table(spark, d, "events"), "value")


@query("agg_corr2", """
SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr,
       count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) AS n_pairs
FROM lineitem WHERE l_returnflag = 'R'""")
def agg_corr2(spark, d):
    return prof.corr2(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", F.col("l_returnflag") == "R")


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_matrix_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem")
    return " UNION ALL ".join(parts)


@query("agg_corr_matrix", _corr_matrix_sql(), headline=True)
def agg_corr_matrix(spark, d):
    return prof.corr_matrix(table(spark, d, "lineitem"), CORR_COLS)


@query("agg_corr_matrix_components", """
SELECT 'e' || i AS col_a, 'e' || j AS col_b, round(corr(CAST(embedding[i] AS DOUBLE), CAST(embedding[j] AS DOUBLE)), 6) AS corr
FROM embeddings, (SELECT unnest(range(1, 65)) AS i) a, (SELECT unnest(range(1, 65)) AS j) b GROUP BY i, j""")
def agg_corr_matrix_components(spark, d):
    """All 4,096 correlations of the 64 vector components: the blocked Gram aggregate."""
    parts = table(spark, d, "embeddings").select(*[F.try_element_at("embedding", F.lit(j)).cast("double").alias(f"e{j}") for j in range(1, 65)])
    return prof.corr_matrix(parts, parts.columns)


@query("agg_quantiles", """
SELECT round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM events""")
def agg_quantiles(spark, d):
    return prof.quantiles(table(spark, d, "events"), "value")


@query("agg_outlier_count", f"""
SELECT round(f.q1, 6) AS q1, round(f.q3, 6) AS q3, round(f.lo, 6) AS lower, round(f.hi, 6) AS upper,
       count(*) FILTER (WHERE e.value < f.lo OR e.value > f.hi) AS n_outliers, count(*) AS n_rows,
       round(count(*) FILTER (WHERE e.value < f.lo OR e.value > f.hi) / count(*), 6) AS share
FROM events e, {IQR_SQL} f GROUP BY f.q1, f.q3, f.lo, f.hi""")
def agg_outlier_count(spark, d):
    return prof.outlier_count(table(spark, d, "events"), "value")


@query("agg_hist1d", """
WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
     w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS width FROM b)
SELECT CAST(bin AS INTEGER) AS bin, round(lo + bin * width, 6) AS lo, round(lo + (bin + 1) * width, 6) AS hi,
       count(*) AS count
FROM (SELECT least(greatest(CAST(floor((p.p_retailprice - w.lo) / w.width) AS INTEGER), 0), 19) AS bin, w.lo, w.width
      FROM part p, w WHERE p.p_retailprice IS NOT NULL)
GROUP BY bin, lo, width""")
def agg_hist1d(spark, d):
    return prof.hist1d(table(spark, d, "part"), "p_retailprice", 20)


def _hist_sql(expr: str, stage: str) -> str:
    return f"""SELECT '{stage}' AS stage, CAST(bin AS INTEGER) AS bin, round(lo + bin * width, 6) AS lo,
       round(lo + (bin + 1) * width, 6) AS hi, count(*) AS count
FROM (SELECT least(greatest(CAST(floor((x - w.lo) / w.width) AS INTEGER), 0), 19) AS bin, w.lo, w.width
      FROM (SELECT {expr} AS x FROM customer) v,
           (SELECT min({expr}) AS lo, CASE WHEN max({expr}) > min({expr}) THEN (max({expr}) - min({expr})) / 20
                   ELSE 1.0 END AS width FROM customer) w
      WHERE x IS NOT NULL)
GROUP BY bin, lo, width"""


@query("agg_hist1d_transform", _hist_sql("c_acctbal", "before") + "\nUNION ALL\n"
       + _hist_sql("CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 6) END", "after"))
def agg_hist1d_transform(spark, d):
    """Histogram of a column before and after a derived-feature transform (log1p)."""
    c = table(spark, d, "customer").select("c_acctbal", F.round(fn.fn_log("c_acctbal"), 6).alias("acct_log"))
    before = prof.hist1d(c, "c_acctbal", 20).select(F.lit("before").alias("stage"), "*")
    after = prof.hist1d(c, "acct_log", 20).select(F.lit("after").alias("stage"), "*")
    return before.unionByName(after)


@query("agg_hist2d", """
WITH b AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl,
                  max(l_extendedprice) AS yh FROM lineitem)
SELECT least(greatest(CAST(floor((l_quantity - xl) / CASE WHEN xh > xl THEN (xh - xl) / 10 ELSE 1.0 END) AS INTEGER), 0), 9) AS bx,
       least(greatest(CAST(floor((l_extendedprice - yl) / CASE WHEN yh > yl THEN (yh - yl) / 10 ELSE 1.0 END) AS INTEGER), 0), 9) AS by,
       l_returnflag AS hue, count(*) AS count
FROM lineitem, b WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL""")
def agg_hist2d(spark, d):
    return prof.hist2d(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", 10)


PAIR_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


def _hist2d_pairs_sql() -> str:
    mm = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in PAIR_COLS)
    bins = ", ".join(
        f"least(greatest(CAST(floor(({c} - a_{c}) / CASE WHEN b_{c} > a_{c} THEN (b_{c} - a_{c}) / 10 ELSE 1.0 END)"
        f" AS INTEGER), 0), 9) AS b_{c}" for c in PAIR_COLS)
    parts = []
    for i, x in enumerate(PAIR_COLS):
        for y in PAIR_COLS[i + 1:]:
            parts.append(f"SELECT '{x}' AS x, '{y}' AS y, b_{x} AS bx, b_{y} AS by, hue, count(*) AS count "
                         f"FROM bn WHERE b_{x} IS NOT NULL AND b_{y} IS NOT NULL GROUP BY ALL")
    return f"""
WITH mm AS (SELECT {mm} FROM lineitem),
bn AS (SELECT {bins}, l_returnflag AS hue FROM lineitem, mm)
{" UNION ALL ".join(parts)}"""


@query("agg_hist2d_pairs", _hist2d_pairs_sql())
def agg_hist2d_pairs(spark, d):
    """Pairs matrix of 2-D histograms split by a category: one min/max pass, one grouped count."""
    return prof.hist2d_pairs(table(spark, d, "lineitem"), PAIR_COLS, "l_returnflag", 10)


@query("agg_scatter", f"""
SELECT nonletter_share AS x, word_share AS y, CAST(quality AS VARCHAR) AS hue FROM ({fx.SQL_DOCS_TASK})""")
def agg_scatter(spark, d):
    return prof.scatter(fx.docs_task(spark, d), "nonletter_share", "word_share", "quality")


@query("agg_scatter_pairs", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x_col, '{b}' AS y_col, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, l_returnflag AS hue FROM lineitem"
    for i, a in enumerate(PAIR_COLS) for b in PAIR_COLS[i + 1:]))
def agg_scatter_pairs(spark, d):
    """Pairs matrix: every point of every pair of columns, one scan."""
    return prof.scatter_pairs(table(spark, d, "lineitem"), PAIR_COLS, "l_returnflag")


@query("agg_scatter_sample", f"""
SELECT nonletter_share AS x, word_share AS y, CAST(quality AS VARCHAR) AS hue
FROM ({fx.SQL_DOCS_TASK}) ORDER BY {sql_hash_key(42, 'row_id')}, row_id LIMIT 100""")
def agg_scatter_sample(spark, d):
    return prof.scatter_sample(fx.docs_task(spark, d), "nonletter_share", "word_share", "quality", 100)


@query("agg_boxplot", f"""
SELECT 'value' AS "column", round(f.q1, 6) AS q1, round(quantile_cont(e.value, 0.5), 6) AS median,
       round(f.q3, 6) AS q3, round(f.q3 - f.q1, 6) AS iqr,
       min(e.value) FILTER (WHERE e.value >= f.lo AND e.value <= f.hi) AS whisker_low,
       max(e.value) FILTER (WHERE e.value >= f.lo AND e.value <= f.hi) AS whisker_high,
       count(*) FILTER (WHERE e.value IS NOT NULL AND NOT (e.value >= f.lo AND e.value <= f.hi)) AS n_outliers
FROM events e, {IQR_SQL} f GROUP BY f.q1, f.q3, f.lo, f.hi""")
def agg_boxplot(spark, d):
    return prof.boxplot(table(spark, d, "events"), "value")


@query("agg_barchart", MISSING_SQL)
def agg_barchart(spark, d):
    """Missing share of every column (bars), zeros included."""
    return prof.missing_counts(fx.docs_nulls(spark, d))


# --- 2.7 windows -----------------------------------------------------------------------

@query("win_rowid", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
                          l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_id,
       l_orderkey, l_linenumber, l_quantity, l_extendedprice
FROM lineitem""", headline=True)
def win_rowid(spark, d):
    """Row ids over the whole row as key (lineitem has no narrower unique key)."""
    li = add_row_id(table(spark, d, "lineitem"), persist_input=False)
    return li.select("row_id", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("win_share", """
SELECT o_orderstatus AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders GROUP BY o_orderstatus""")
def win_share(spark, d):
    from pyspark.sql import Window
    c = prof.value_counts(table(spark, d, "orders"), "o_orderstatus")
    return c.select("value", "count", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


# --- 2.8 sorts and limits --------------------------------------------------------------

@query("srt_missing", f"""
SELECT *, row_number() OVER (ORDER BY missing DESC, "column") AS rank FROM ({MISSING_SQL})""")
def srt_missing(spark, d):
    from tricolor.sources.rowid import ordered_rank
    m = prof.missing_counts(fx.docs_nulls(spark, d))
    return ordered_rank(m, [F.desc("missing"), F.col("column")], "rank")


@query("srt_class", """
SELECT quality AS class, count(*) AS count, row_number() OVER (ORDER BY quality) AS rank
FROM labels GROUP BY quality""")
def srt_class(spark, d):
    from tricolor.sources.rowid import ordered_rank
    c = lab.label_counts(table(spark, d, "labels"), "quality", "raw").drop("stage")
    return ordered_rank(c, [F.col("class")], "rank")


@query("srt_limit5", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5""")
def srt_limit5(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(5)


# --- 2.9 set operations ----------------------------------------------------------------

@query("set_union", """
SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal, 'supplier' AS kind
FROM supplier
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'customer' FROM customer""")
def set_union(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                           F.col("s_nationkey").alias("nationkey"),
                                           F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                           F.col("c_nationkey").alias("nationkey"),
                                           F.col("c_acctbal").alias("acctbal"), F.lit("customer").alias("kind"))
    return s.unionByName(c)


@query("set_except_cols", """
SELECT column_name AS "column" FROM (DESCRIBE orders)
WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE lineitem))""")
def set_except_cols(spark, d):
    """Training columns absent from the test table (schema difference, order kept)."""
    train, test = table(spark, d, "orders"), table(spark, d, "lineitem")
    missing = [(c,) for c in train.columns if c not in test.columns]
    return spark.createDataFrame(missing, "column string")


@query("set_equal_labels", """
(SELECT DISTINCT o_orderstatus AS value, 'train_only' AS side FROM orders WHERE o_orderstatus IS NOT NULL
 EXCEPT SELECT DISTINCT o_orderstatus, 'train_only' FROM orders WHERE o_orderstatus <> 'P')""")
def set_equal_labels(spark, d):
    o = table(spark, d, "orders")
    return lab.label_set_diff(o, o.where(F.col("o_orderstatus") != "P"), "o_orderstatus")


@query("set_intersect_cols", """
SELECT column_name AS "column" FROM (DESCRIBE lineitem)
WHERE column_name IN ('l_quantity', 'l_tax', 'l_comment', 'l_shipdate', 'l_receiptdate')""")
def set_intersect_cols(spark, d):
    """Requested columns that the table actually has."""
    li = table(spark, d, "lineitem")
    wanted = ["l_quantity", "l_tax", "l_comment", "l_shipdate", "l_receiptdate"]
    have = [(c,) for c in li.columns if c in wanted]
    return spark.createDataFrame(have, "column string")


# --- 2.10 scalar functions -------------------------------------------------------------

def _li2(spark, d, expr, name="value"):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", expr.alias(name))


@query("fn_add", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice, 6) AS value FROM lineitem")
def fn_add(spark, d):
    return _li2(spark, d, fn.fn_add("l_quantity", "l_extendedprice"))


@query("fn_subtract", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 6) AS value FROM lineitem")
def fn_subtract(spark, d):
    return _li2(spark, d, fn.fn_subtract("l_extendedprice", "l_quantity"))


@query("fn_multiply", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 6) AS value FROM lineitem")
def fn_multiply(spark, d):
    return _li2(spark, d, fn.fn_multiply("l_quantity", "l_extendedprice"))


@query("fn_divide", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity + 1e-9, 0), 6) AS value FROM lineitem""")
def fn_divide(spark, d):
    return _li2(spark, d, fn.fn_divide("l_extendedprice", "l_quantity"))


@query("fn_log", """
SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 6) END AS value FROM customer""")
def fn_log(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.fn_log("c_acctbal").alias("value"))


@query("fn_square", "SELECT c_custkey, round(c_acctbal * c_acctbal, 6) AS value FROM customer")
def fn_square(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.fn_square("c_acctbal").alias("value"))


@query("fn_dispatch", """
SELECT p_partkey, op, value FROM (
  SELECT p_partkey, 'Add' AS op, round(p_retailprice + p_size, 6) AS value FROM part
  UNION ALL SELECT p_partkey, 'Subtract', round(p_retailprice - p_size, 6) FROM part
  UNION ALL SELECT p_partkey, 'Multiply', round(p_retailprice * p_size, 6) FROM part
  UNION ALL SELECT p_partkey, 'Divide', round(p_retailprice / nullif(p_size + 1e-9, 0), 6) FROM part
  UNION ALL SELECT p_partkey, 'Log', CASE WHEN p_retailprice > -1 THEN round(ln(1 + p_retailprice), 6) END FROM part
  UNION ALL SELECT p_partkey, 'Square', round(p_retailprice * p_retailprice, 6) FROM part)""")
def fn_dispatch(spark, d):
    """Every named operation through the dispatcher, long form (one scan, one explode)."""
    p = table(spark, d, "part")
    entries = [F.struct(F.lit(op).alias("op"), fn.feature_expr(op, "p_retailprice", "p_size").alias("value"))
               for op in fn.FEATURE_OPS]
    return p.select("p_partkey", F.explode(F.array(*entries)).alias("e")).select("p_partkey", "e.op", "e.value")


@query("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS value FROM customer")
def fn_abs(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.fn_abs("c_acctbal").alias("value"))


@query("fn_sigmoid", f"""
SELECT row_id, round(1.0 / (1.0 + exp(-(score * 10 - 5))), 6) AS value FROM ({fx.SQL_SCORED})""")
def fn_sigmoid(spark, d):
    s = fx.scored(spark, d)
    return s.select("row_id", fn.fn_sigmoid(F.col("score") * 10 - 5).alias("value"))


@query("fn_threshold", f"SELECT row_id, CAST(score >= 0.5 AS INTEGER) AS value FROM ({fx.SQL_SCORED})")
def fn_threshold(spark, d):
    return fx.scored(spark, d).select("row_id", fn.fn_threshold("score").alias("value"))


@query("fn_flip", f"""
SELECT row_id, 1 - pred AS flipped_pred, round(1 - score, 6) AS flipped_prob, -score AS flipped_score
FROM ({fx.SQL_SCORED})""")
def fn_flip(spark, d):
    s = fx.scored(spark, d)
    return s.select("row_id", fn.fn_flip_pred("pred").alias("flipped_pred"),
                    fn.fn_flip_prob("score").alias("flipped_prob"), fn.fn_flip_score("score").alias("flipped_score"))


@query("fn_traffic", f"""
SELECT row_id,
       CASE WHEN pred = 0 AND 1 - score >= 0.85 THEN 'Green' WHEN pred = 1 AND score >= 0.85 THEN 'Red'
            ELSE 'Yellow' END AS light,
       CASE WHEN pred = 0 AND 1 - score >= 0.6 THEN 'Green' WHEN pred = 1 AND score >= 0.7 THEN 'Red'
            ELSE 'Yellow' END AS light_custom
FROM ({fx.SQL_SCORED})""", headline=True)
def fn_traffic(spark, d):
    s = fx.scored(spark, d)
    return s.select("row_id", fn.fn_traffic("pred", "score").alias("light"),
                    fn.fn_traffic("pred", "score", 0.6, 0.7).alias("light_custom"))


@query("fn_round", "SELECT c_custkey, round(c_acctbal / 3, 2) AS r2, round(c_acctbal / 3, 4) AS r4 FROM customer")
def fn_round(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", fn.fn_round(F.col("c_acctbal") / 3, 2).alias("r2"),
                    fn.fn_round(F.col("c_acctbal") / 3, 4).alias("r4"))
