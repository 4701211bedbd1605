"""Queries for splits, sampling, folds, transforms, the preparation recipe and PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from tricolor.functions.hashing import sql_hash_int, sql_hash_key, sql_hash_uniform
from tricolor.operators import sampling as smp
from tricolor.operators.columns import IqrFilter, drop_columns
from tricolor.operators.labels import label_counts
from tricolor.operators.pca import PcaModel
from tricolor.operators.transform import MinMaxScaling, StandardScaling
from tricolor.plans.q_relational import split_sql
from tricolor.plans.recipe import Recipe
from tricolor.plans.registry import query
from tricolor.sources import fixtures as fx
from tricolor.sources.readers import table
from tricolor.sources.rowid import add_row_id

TASK = fx.SQL_DOCS_TASK
SPLIT = split_sql(TASK)
F3 = fx.FEATURES


def _split(spark, d):
    s = smp.split_train_val(fx.docs_task(spark, d), 0.2)
    return s.where(~F.col("is_val")).drop("is_val"), s.where(F.col("is_val")).drop("is_val")


# --- 2.11 split, resampling, folds -----------------------------------------------------

@query("spl_train_val", f"SELECT row_id, quality, is_val FROM {SPLIT}", headline=True)
def spl_train_val(spark, d):
    return smp.split_train_val(fx.docs_task(spark, d), 0.2).select("row_id", "quality", "is_val")


@query("spl_importance", f"""
SELECT row_id, o_orderkey, is_val FROM {split_sql(
    'SELECT row_number() OVER (ORDER BY o_orderkey) AS row_id, o_orderkey FROM orders')}""")
def spl_importance(spark, d):
    o = add_row_id(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], persist_input=False)
    return smp.split_train_val(o, 0.2)


CLASS_RANK = f"""(SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {sql_hash_key(42, 'row_id')}, row_id)
                    AS crank FROM ({TASK}))"""


@query("sam_under", f"""
SELECT row_id, quality, n_chars FROM {CLASS_RANK}
WHERE crank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM ({TASK}) GROUP BY quality))""", headline=True)
def sam_under(spark, d):
    return smp.under_sample(fx.docs_task(spark, d), "quality").select("row_id", "quality", "n_chars")


def _over_sql() -> str:
    return f"""
WITH c AS (SELECT quality, count(*) AS n FROM ({TASK}) GROUP BY quality),
     mx AS (SELECT max(n) AS nmax, (SELECT max(row_id) FROM ({TASK})) AS base FROM c),
     mn AS (SELECT c.quality, c.n, mx.nmax - c.n AS need FROM c, mx WHERE c.n < mx.nmax),
     draws AS (SELECT r.range AS j,
                      (({sql_hash_int("42:over:0", "r.range")}) % mn.n) + 1 AS crank
               FROM mn, range((SELECT need FROM mn)) r)
SELECT row_id, quality, n_chars, false AS is_synthetic FROM ({TASK})
UNION ALL
SELECT mx.base + 1 + draws.j AS row_id, k.quality, k.n_chars, true AS is_synthetic
FROM draws JOIN {CLASS_RANK} k ON k.crank = draws.crank AND k.quality = (SELECT quality FROM mn), mx"""


@query("sam_over", _over_sql())
def sam_over(spark, d):
    return smp.over_sample(fx.docs_task(spark, d), "quality").select("row_id", "quality", "n_chars", "is_synthetic")


def _smote_sql() -> str:
    dist = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in F3)
    synth = ", ".join(f"x.{c} + d.u * (y.{c} - x.{c}) AS {c}" for c in F3)
    return f"""
WITH t AS ({TASK}), c AS (SELECT quality, count(*) AS n FROM t GROUP BY quality),
mn AS (SELECT quality AS cls, n, (SELECT max(n) FROM c) - n AS need FROM c WHERE n < (SELECT max(n) FROM c)),
m AS (SELECT * FROM t WHERE quality = (SELECT cls FROM mn)),
rk AS (SELECT *, row_number() OVER (ORDER BY {sql_hash_key(42, 'row_id')}, row_id) AS crank FROM m),
nn AS (SELECT a.row_id AS qid, b.row_id AS rid,
              row_number() OVER (PARTITION BY a.row_id ORDER BY sqrt({dist}), b.row_id) AS nn_rank
       FROM m a, m b WHERE a.row_id <> b.row_id),
draws AS (SELECT r.range AS j, ({sql_hash_int("42:smote:0", "r.range")} % mn.n) + 1 AS crank,
                 ({sql_hash_int("42:smote-nn:0", "r.range")} % 5) + 1 AS nn_rank,
                 {sql_hash_uniform("42:smote-gap:0", "r.range")} AS u
          FROM mn, range((SELECT need FROM mn)) r)
SELECT row_id, quality, {", ".join(F3)}, false AS is_synthetic FROM t
UNION ALL
SELECT (SELECT max(row_id) FROM t) + 1 + x.j AS row_id, x.quality, {", ".join(f"round({c}, 6) AS {c}" for c in F3)},
       true AS is_synthetic
FROM (SELECT d.j, x.quality, {synth}
      FROM draws d JOIN rk x ON x.crank = d.crank
      JOIN nn ON nn.qid = x.row_id AND nn.nn_rank = d.nn_rank JOIN m y ON y.row_id = nn.rid) x"""


@query("sam_smote", _smote_sql())
def sam_smote(spark, d):
    """SMOTE rows for the minority class (exact kNN); checked against brute force in tests."""
    t = fx.docs_task(spark, d)
    out = smp.smote(t, "quality", F3, k=5)
    return out.select("row_id", "quality", *F3, "is_synthetic")


@query("sam_report", f"""
SELECT 'before' AS stage, quality AS class, count(*) AS count FROM ({TASK}) GROUP BY quality
UNION ALL
SELECT 'after_under', quality, count(*) FROM {CLASS_RANK}
WHERE crank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM ({TASK}) GROUP BY quality)) GROUP BY quality""")
def sam_report(spark, d):
    t = fx.docs_task(spark, d)
    return label_counts(t, "quality", "before").unionByName(
        label_counts(smp.under_sample(t, "quality"), "quality", "after_under"))


@query("cv_folds", f"""
SELECT row_id, quality, CAST((crank - 1) % 10 AS INTEGER) AS fold FROM {CLASS_RANK}""")
def cv_folds(spark, d):
    return smp.stratified_folds(fx.docs_task(spark, d), "quality", 10).select("row_id", "quality", "fold")


@query("cv_folds_plain", f"""
SELECT row_id, CAST((row_number() OVER (ORDER BY {sql_hash_key(42, 'row_id')}, row_id) - 1) % 5 AS INTEGER) AS fold
FROM ({TASK})""")
def cv_folds_plain(spark, d):
    return smp.plain_folds(fx.docs_task(spark, d), 5).select("row_id", "fold")


# --- 2.12 transforms and the recipe ----------------------------------------------------

def _minmax_sql(cols, src_train, src_apply) -> str:
    stats = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols)
    exprs = ", ".join(f"round((a.{c} - st.mn_{c}) / CASE WHEN st.mx_{c} <> st.mn_{c} THEN st.mx_{c} - st.mn_{c} "
                      f"ELSE 1 END, 6) AS {c}" for c in cols)
    return f"SELECT a.row_id, {exprs} FROM {src_apply} a, (SELECT {stats} FROM {src_train}) st"


@query("trn_minmax", f"""
WITH s AS {SPLIT}
{_minmax_sql(F3, '(SELECT * FROM s WHERE NOT is_val)', '(SELECT * FROM s WHERE is_val)')}""")
def trn_minmax(spark, d):
    train, val = _split(spark, d)
    return MinMaxScaling.fit(train, F3).transform(val).select("row_id", *F3)


def _standard_sql(cols, src_train, src_apply) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    exprs = ", ".join(f"round((a.{c} - st.m_{c}) / CASE WHEN st.s_{c} > 0 THEN st.s_{c} ELSE 1 END, 6) AS {c}"
                      for c in cols)
    return f"SELECT a.row_id, {exprs} FROM {src_apply} a, (SELECT {stats} FROM {src_train}) st"


@query("trn_standard", f"""
WITH s AS {SPLIT}
{_standard_sql(F3, '(SELECT * FROM s WHERE NOT is_val)', '(SELECT * FROM s WHERE is_val)')}""", headline=True)
def trn_standard(spark, d):
    train, val = _split(spark, d)
    return StandardScaling.fit(train, F3).transform(val).select("row_id", *F3)


@query("trn_feature", f"""
SELECT row_id, round(nonletter_share / nullif(word_share + 1e-9, 0), 6) AS ratio,
       CASE WHEN n_chars > -1 THEN round(ln(1 + n_chars), 6) END AS n_chars_log
FROM ({TASK})""")
def trn_feature(spark, d):
    r = Recipe("quality")
    t = r.feature(fx.docs_task(spark, d), "Divide", "nonletter_share", "word_share", "ratio")
    t = r.feature(t, "Log", "n_chars", name="n_chars_log")
    return t.select("row_id", "ratio", "n_chars_log")


@query("trn_outlier", f"""
WITH s AS {SPLIT}, tr AS (SELECT * FROM s WHERE NOT is_val),
     f AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM tr)
SELECT tr.row_id, tr.n_chars FROM tr, f
WHERE NOT (tr.n_chars < f.q1 - 1.5 * (f.q3 - f.q1) OR tr.n_chars > f.q3 + 1.5 * (f.q3 - f.q1))""")
def trn_outlier(spark, d):
    train, _ = _split(spark, d)
    return IqrFilter.fit(train, "n_chars").keep(train).select("row_id", "n_chars")


@query("trn_drop", f"SELECT row_id, n_chars, nonletter_share, word_share, quality, is_val FROM {SPLIT}")
def trn_drop(spark, d):
    s = smp.split_train_val(fx.docs_task(spark, d), 0.2)
    return drop_columns(s, ["doc_id", "lang", "source"])


def _recipe(spark, d):
    """Recipe fitted on the training part: one-hot lang, standardise n_chars, add ratio,
    min-max word_share, drop lang_fr."""
    train, val = _split(spark, d)
    train = train.drop("doc_id", "source")
    r = Recipe("quality")
    t = r.fit_base(train, 0, 1, categorical=["lang"])
    t = r.standard(t, ["n_chars"])
    t = r.feature(t, "Divide", "nonletter_share", "word_share", "ratio")
    t = r.minmax(t, ["word_share"])
    t = r.drop(t, ["lang_fr"])
    return r, t, val


@query("trn_replay", f"""
WITH s AS {SPLIT}, tr AS (SELECT * FROM s WHERE NOT is_val),
     st AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS sd, min(word_share) AS wmn, max(word_share) AS wmx FROM tr)
SELECT v.row_id, v.quality,
       CASE WHEN v.lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lang_en,
       CASE WHEN v.lang = 'es' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lang_es,
       round((v.n_chars - st.m) / CASE WHEN st.sd > 0 THEN st.sd ELSE 1 END, 6) AS n_chars,
       v.nonletter_share,
       round((v.word_share - st.wmn) / CASE WHEN st.wmx <> st.wmn THEN st.wmx - st.wmn ELSE 1 END, 6) AS word_share,
       round(v.nonletter_share / nullif(v.word_share + 1e-9, 0), 6) AS ratio
FROM (SELECT * FROM s WHERE is_val) v, st""", headline=True)
def trn_replay(spark, d):
    r, _, val = _recipe(spark, d)
    return r.apply(val.drop("doc_id", "source"))


@query("trn_log")
def trn_log(spark, d):
    r, _, _ = _recipe(spark, d)
    return r.describe(spark)


@query("trn_final_sets", f"""
WITH s AS {SPLIT}, tr AS (SELECT * FROM s WHERE NOT is_val),
     k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {sql_hash_key(42, 'row_id')}, row_id) AS crank
           FROM tr)
SELECT row_id, quality, 'train' AS part FROM k
WHERE crank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM tr GROUP BY quality))
UNION ALL SELECT row_id, quality, 'val' FROM s WHERE is_val""")
def trn_final_sets(spark, d):
    """Final sets: the rebalanced training part (under-sampling chosen) and the validation part."""
    train, val = _split(spark, d)
    final_train = smp.under_sample(train, "quality")
    return (final_train.select("row_id", "quality", F.lit("train").alias("part"))
            .unionByName(val.select("row_id", "quality", F.lit("val").alias("part"))))


def _pca(spark, d):
    train, val = _split(spark, d)
    return PcaModel.fit(train, F3), train, val


@query("pca_loadings")
def pca_loadings(spark, d):
    m, _, _ = _pca(spark, d)
    return m.loadings(spark)


@query("win_cumvar")
def win_cumvar(spark, d):
    m, _, _ = _pca(spark, d)
    return m.variance(spark)


@query("pca_apply")
def pca_apply(spark, d):
    m, train, val = _pca(spark, d)
    return (m.transform(train, 2, ["row_id", "quality"]).withColumn("part", F.lit("train"))
            .unionByName(m.transform(val, 2, ["row_id", "quality"]).withColumn("part", F.lit("val"))))


@query("pca_test")
def pca_test(spark, d):
    """Fitted scaler + PCA applied to every document (the scoring table)."""
    m, _, _ = _pca(spark, d)
    return m.transform(fx.docs_features(spark, d), 2, ["doc_id"])


@query("pca_embeddings")
def pca_embeddings(spark, d):
    """PCA over the 64-dimensional embedding vectors: explained-variance ratios, cumulative."""
    e = table(spark, d, "embeddings")
    dims = 64
    wide = e.select(F.col("vec_id").alias("row_id"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])
    m = PcaModel.fit(wide, [f"e{i}" for i in range(dims)])
    return m.variance(spark)
