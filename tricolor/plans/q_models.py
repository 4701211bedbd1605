"""Queries for classifiers, tuning and cross-validation, evaluation, scoring and importances.

Model outputs are binned / iterative and have no SQL form, except naive Bayes and kNN on raw
features (closed form / brute force) and every metric computed on the fixed ``scored`` table.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tricolor.functions.hashing import sql_hash_key, sql_hash_uniform
from tricolor.operators import importance as imp
from tricolor.operators.evaluate import (
    long_predictions,
    predict_all,
    score_table,
    test_table,
    train_export,
    train_export_metrics,
    validation_table,
)
from tricolor.operators.metrics import auc, confusion_metrics
from tricolor.operators.models.bagging import HashBagging, poisson_steps
from tricolor.operators.models.base import pred_col, prob_col
from tricolor.operators.models.catalog import grid, model
from tricolor.operators.models.ensemble import Stacking, Voting
from tricolor.operators.neighbor_info import neighbor_information
from tricolor.operators.profile import value_grid
from tricolor.operators.tune import add_folds, cv_summary, fold_metrics, pooled_metrics, search_cv
from tricolor.plans.q_relational import split_sql
from tricolor.plans.registry import query
from tricolor.plans.workflow import LABEL, prepared_task, scoring_table
from tricolor.sources import fixtures as fx
from tricolor.sources.readers import table

TASK = fx.SQL_DOCS_TASK
SPLIT = split_sql(TASK)
F3 = fx.FEATURES


def _val_predictions(spark, d, name, **params):
    p = prepared_task(spark, d)
    fitted = model(name, **params).fit(p.train, p.features, LABEL)
    return fitted.predict(p.val).select("row_id", LABEL, pred_col(name), prob_col(name))


def _raw_split(spark, d):
    from tricolor.operators.sampling import split_train_val
    s = split_train_val(fx.docs_task(spark, d), 0.2)
    return s.where(~F.col("is_val")).drop("is_val"), s.where(F.col("is_val")).drop("is_val")


def _metrics_sql(src: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""
(SELECT {g}tp, fp, fn, tn, n,
        round(coalesce((tp + tn) / nullif(n, 0), 0), 6) AS accuracy,
        round(pr, 6) AS precision, round(rc, 6) AS recall,
        round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1
 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc
       FROM (SELECT {g}count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
                    count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
                    count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn,
                    count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) AS n
             FROM ({src}) {by})))"""


def _auc_sql(src: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    by = f"GROUP BY {group}" if group else ""
    join = f"USING ({group})" if group else "ON true"
    return f"""
(SELECT {'t.' + group + ', ' if group else ''}t.P, t.N,
        CASE WHEN t.P > 0 AND t.N > 0 AND t.nn = 0 THEN round(coalesce(x.u, 0) / (t.P * t.N), 6) END AS auc
 FROM (SELECT {g}count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y = 0) AS N,
              count(*) FILTER (WHERE prob IS NULL) AS nn FROM ({src}) {by}) t
 LEFT JOIN (SELECT {g}sum(pos * (nb + neg / 2.0)) AS u
            FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING
                                                      AND 1 PRECEDING), 0) AS nb
                  FROM (SELECT {g}prob, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
                        FROM ({src}) WHERE prob IS NOT NULL GROUP BY {g}prob))
            {by}) x {join})"""


# --- SQL twins on the prepared task ----------------------------------------------------------

PREPARED = f"""
s AS {SPLIT}, st AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(nonletter_share) AS m2,
  stddev_pop(nonletter_share) AS s2, avg(word_share) AS m3, stddev_pop(word_share) AS s3 FROM s WHERE NOT is_val),
pt AS (SELECT row_id, quality, is_val, CAST(lang = 'en' AS DOUBLE) AS lang_en, CAST(lang = 'es' AS DOUBLE) AS lang_es,
  CAST(lang = 'fr' AS DOUBLE) AS lang_fr, (n_chars - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END AS n_chars,
  (nonletter_share - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END AS nonletter_share,
  (word_share - m3) / CASE WHEN s3 > 0 THEN s3 ELSE 1 END AS word_share FROM s, st)"""
PREPARED_FEATURES = ["lang_en", "lang_es", "lang_fr", "n_chars", "nonletter_share", "word_share"]


def _folded_sql(k: int, stratified: bool) -> str:
    """fo (training rows, fold, features as a list) and uf (row, feature, value)."""
    part = "PARTITION BY quality " if stratified else ""
    return f"""{PREPARED},
fo AS (SELECT row_id, quality, [{", ".join(PREPARED_FEATURES)}] AS x,
              (row_number() OVER ({part}ORDER BY {sql_hash_key(42, "row_id")}, row_id) - 1) % {k} AS fold FROM pt WHERE NOT is_val),
uf AS (SELECT row_id, quality, fold, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM fo)"""


def _nb_folds_sql(k: int, smoothing: list[float]) -> str:
    """oof (candidate, fold, y, pred, prob): each row by naive Bayes fitted on the other folds."""
    return f"""{_folded_sql(k, True)},
sm AS (SELECT unnest([{", ".join(f"CAST({v!r} AS DOUBLE)" for v in smoothing)}]) AS sm, unnest(range({len(smoothing)})) AS candidate),
ps AS (SELECT f.range AS fold, u.quality AS c, u.j, count(*) AS n, avg(v) AS m, var_pop(v) AS w
       FROM uf u JOIN range({k}) f ON u.fold <> f.range GROUP BY ALL),
ep AS (SELECT fold, max(w) AS w FROM (SELECT f.range AS fold, u.j, var_pop(v) AS w FROM uf u JOIN range({k}) f ON u.fold <> f.range GROUP BY ALL)
       GROUP BY fold),
jl AS (SELECT candidate, u.fold, u.row_id, u.quality, ps.c, ln(any_value(ps.n)) + sum(-0.5 * ln(2 * pi() * (ps.w + sm * ep.w))
              - (u.v - ps.m) * (u.v - ps.m) / (2 * (ps.w + sm * ep.w))) AS jll
       FROM uf u JOIN ps USING (fold, j) JOIN ep USING (fold), sm GROUP BY ALL),
oof AS (SELECT a.candidate, a.fold, a.row_id, a.quality AS y, CAST(b.jll > a.jll AS INTEGER) AS pred, 1 / (1 + exp(a.jll - b.jll)) AS prob
        FROM jl a JOIN jl b ON a.candidate = b.candidate AND a.row_id = b.row_id AND a.c = 0 AND b.c = 1)"""


def _pls_sql(rows: str, components: int = 2) -> str:
    """Two-component PLS1 per ``grp`` from rows (grp, row_id, y, j, v): coef (grp, j, m, s, b) and ty (grp, m, s)."""
    assert components == 2
    return f"""u AS ({rows}),
tm AS (SELECT grp, j, avg(v) AS m, CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) ELSE 1 END AS s FROM u GROUP BY grp, j),
ty AS (SELECT grp, avg(y) AS m, stddev_samp(y) AS s FROM u WHERE j = 1 GROUP BY grp),
z AS (SELECT u.grp, u.row_id, u.j, (u.v - tm.m) / tm.s AS z, (u.y - ty.m) / ty.s AS zy FROM u JOIN tm USING (grp, j) JOIN ty USING (grp)),
g AS (SELECT a.grp, a.j AS i, b.j, sum(a.z * b.z) AS c FROM z a JOIN z b ON a.grp = b.grp AND a.row_id = b.row_id GROUP BY ALL),
x1 AS (SELECT grp, j, sum(z * zy) AS c FROM z GROUP BY grp, j),
w1 AS (SELECT grp, j, c, c / sqrt(sum(c * c) OVER (PARTITION BY grp)) AS w FROM x1),
k1 AS (SELECT g.grp, g.i AS j, sum(g.c * w1.w) AS xw FROM g JOIN w1 ON w1.grp = g.grp AND w1.j = g.j GROUP BY ALL),
t1 AS (SELECT grp, sum(w * xw) AS tt, sum(w * c) AS wc FROM k1 JOIN w1 USING (grp, j) GROUP BY grp),
x2 AS (SELECT grp, j, w, xw / tt AS p, wc / tt AS q, c - xw / tt * wc AS c FROM w1 JOIN k1 USING (grp, j) JOIN t1 USING (grp)),
w2 AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY grp)) AS ww FROM x2),
r2 AS (SELECT *, ww - sum(p * ww) OVER (PARTITION BY grp) * w AS r FROM w2),
k2 AS (SELECT g.grp, g.i AS j, sum(g.c * r2.r) AS xr FROM g JOIN r2 ON r2.grp = g.grp AND r2.j = g.j GROUP BY ALL),
t2 AS (SELECT grp, sum(r * xr) AS tt, sum(r * c) AS rc FROM k2 JOIN r2 USING (grp, j) GROUP BY grp),
coef AS (SELECT grp, j, tm.m, tm.s, r2.w * r2.q + r2.r * t2.rc / t2.tt AS b FROM r2 JOIN t2 USING (grp) JOIN tm USING (grp, j))"""


_PREPARED_LONG = f"""pl AS (SELECT row_id, quality, is_val, unnest([{", ".join(PREPARED_FEATURES)}]) AS v,
  unnest(range(1, {len(PREPARED_FEATURES) + 1})) AS j FROM pt)"""
PLS_ALL = f"""{PREPARED}, {_PREPARED_LONG},
{_pls_sql("SELECT 0 AS grp, row_id, quality AS y, j, v FROM pl WHERE NOT is_val")},
sc AS (SELECT pl.row_id, pl.quality, pl.is_val, any_value(ty.m) + any_value(ty.s) * sum(coef.b * (pl.v - coef.m) / coef.s) AS score
       FROM pl JOIN coef USING (j), ty GROUP BY ALL)"""


# --- 2.14 classifiers ------------------------------------------------------------------

_SQL = {"PLSDA": f"""
WITH {PLS_ALL}
SELECT row_id, quality, CAST(score >= 0.5 AS INTEGER) AS PLSDA_Prediction, round(score, 6) AS PLSDA_Prob FROM sc WHERE is_val"""}

for _name in ["Ridge", "Lasso", "ElasticNet", "PLSDA", "SVM", "DecisionTree", "RandomForest", "GBM", "MLP",
              "Bagging", "Pasting"]:
    _qid = {"DecisionTree": "mod_tree", "RandomForest": "mod_rf", "GBM": "mod_gbm", "MLP": "mod_mlp",
            "Bagging": "mod_bagging", "Pasting": "mod_pasting", "PLSDA": "mod_plsda", "SVM": "mod_svm",
            "Ridge": "mod_ridge", "Lasso": "mod_lasso", "ElasticNet": "mod_elasticnet"}[_name]

    def _make(name):
        def run(spark, d):
            return _val_predictions(spark, d, name)
        run.__doc__ = f"{name}: fitted on the prepared training part, validation predictions."
        return run

    query(_qid, _SQL.get(_name), headline=_name in ("Ridge", "RandomForest"))(_make(_name))


def _nb_sql(apply_where: str, extra: str = "") -> str:
    """Gaussian NB fitted on the training part, applied to the rows selected by ``apply_where``."""
    return f"""
WITH s AS {SPLIT}, tr AS (SELECT * FROM s WHERE NOT is_val),
cs AS (SELECT quality AS c, count(*) AS n,
              avg(n_chars) AS m1, var_pop(n_chars) AS v1, avg(nonletter_share) AS m2, var_pop(nonletter_share) AS v2,
              avg(word_share) AS m3, var_pop(word_share) AS v3 FROM tr GROUP BY quality),
tot AS (SELECT count(*) AS n, 1e-9 * greatest(var_pop(n_chars), var_pop(nonletter_share), var_pop(word_share)) AS eps
        FROM tr),
p AS (SELECT cs.c, cs.n / tot.n AS prior, cs.m1, cs.m2, cs.m3, cs.v1 + tot.eps AS w1, cs.v2 + tot.eps AS w2,
             cs.v3 + tot.eps AS w3 FROM cs, tot),
j AS (SELECT v.row_id, v.quality, v.n_chars, v.nonletter_share, v.word_share, p.c,
             ln(p.prior) - 0.5 * ln(2 * pi() * p.w1) - (v.n_chars - p.m1) * (v.n_chars - p.m1) / (2 * p.w1)
                         - 0.5 * ln(2 * pi() * p.w2) - (v.nonletter_share - p.m2) * (v.nonletter_share - p.m2) / (2 * p.w2)
                         - 0.5 * ln(2 * pi() * p.w3) - (v.word_share - p.m3) * (v.word_share - p.m3) / (2 * p.w3) AS jll
      FROM (SELECT * FROM s WHERE {apply_where}) v, p)
SELECT j0.row_id, j0.quality, {extra}CAST(j1.jll > j0.jll AS INTEGER) AS NB_Prediction,
       round(1 / (1 + exp(j0.jll - j1.jll)), 6) AS NB_Prob
FROM j j0 JOIN j j1 ON j0.row_id = j1.row_id AND j0.c = 0 AND j1.c = 1"""


NB_SQL = _nb_sql("is_val")


@query("mod_nb", NB_SQL, headline=True)
def mod_nb(spark, d):
    """Gaussian naive Bayes on the raw features (closed form: SQL-checkable)."""
    train, val = _raw_split(spark, d)
    fitted = model("NB").fit(train, F3, LABEL)
    return fitted.predict(val).select("row_id", LABEL, "NB_Prediction", "NB_Prob")


_BAGS = 10


def _bagged_nb_sql(name: str, drawn: str) -> str:
    """Mean probability of naive Bayes over the bags of ``drawn`` (bag, quality, the features), with copies."""
    return f"""
WITH s AS {SPLIT}, tr AS (SELECT bag, s.* FROM s, (SELECT unnest(range({_BAGS})) AS bag) WHERE NOT is_val),
dr AS ({drawn}),
u AS (SELECT bag, quality AS c, unnest([{", ".join(F3)}]) AS v, unnest(range({len(F3)})) AS j FROM dr),
cs AS (SELECT bag, c, j, count(*) AS n, avg(v) AS m, var_pop(v) AS w FROM u GROUP BY bag, c, j),
ep AS (SELECT bag, 1e-9 * max(w) AS eps FROM (SELECT bag, j, var_pop(v) AS w FROM u GROUP BY bag, j) GROUP BY bag),
x AS (SELECT row_id, quality, unnest([{", ".join(F3)}]) AS v, unnest(range({len(F3)})) AS j FROM s WHERE is_val),
jl AS (SELECT bag, row_id, any_value(quality) AS quality, c, ln(any_value(n)) + sum(-0.5 * ln(2 * pi() * (w + eps)) - (v - m) * (v - m) / (2 * (w + eps))) AS jll
       FROM x JOIN cs USING (j) JOIN ep USING (bag) GROUP BY bag, row_id, c),
pr AS (SELECT a.row_id, any_value(a.quality) AS quality, avg(1 / (1 + exp(a.jll - b.jll))) AS prob
       FROM jl a JOIN jl b ON a.bag = b.bag AND a.row_id = b.row_id AND a.c = 0 AND b.c = 1 GROUP BY a.row_id)
SELECT row_id, quality, CAST(prob > 0.5 AS INTEGER) AS {name}_Prediction, round(prob, 6) AS {name}_Prob FROM pr"""


_BAG_KEY = "(bag || ':' || row_id)"
_TIMES = " + ".join(f"CAST({sql_hash_uniform('42:bag', _BAG_KEY)} >= CAST({v!r} AS DOUBLE) AS INTEGER)" for v in poisson_steps(1.0))


@query("mod_bagging_nb", _bagged_nb_sql("BaggedNB", f"SELECT * FROM (SELECT *, unnest(range({_TIMES})) AS copy FROM tr)"))
def mod_bagging_nb(spark, d):
    """Naive Bayes bagged over 10 hash-drawn bootstrap samples: one aggregate fits all bags."""
    train, val = _raw_split(spark, d)
    fitted = HashBagging("BaggedNB", model("NB"), _BAGS).fit(train, F3, LABEL)
    return fitted.predict(val).select("row_id", LABEL, "BaggedNB_Prediction", "BaggedNB_Prob")


@query("mod_pasting_nb", _bagged_nb_sql("PastedNB", f"""
SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY bag ORDER BY {sql_hash_key('42:paste', _BAG_KEY)}, row_id)
                         <= floor(CAST(0.6 AS DOUBLE) * count(*) OVER (PARTITION BY bag))"""))
def mod_pasting_nb(spark, d):
    """Naive Bayes pasted over 10 exact samples of 0.6 of the rows, without replacement."""
    train, val = _raw_split(spark, d)
    fitted = HashBagging("PastedNB", model("NB"), _BAGS, 0.6, bootstrap=False).fit(train, F3, LABEL)
    return fitted.predict(val).select("row_id", LABEL, "PastedNB_Prediction", "PastedNB_Prob")


KNN_SQL = f"""
WITH s AS {SPLIT}, tr AS (SELECT * FROM s WHERE NOT is_val), v AS (SELECT * FROM s WHERE is_val),
d AS (SELECT v.row_id, v.quality, t.quality AS y,
             row_number() OVER (PARTITION BY v.row_id ORDER BY
               sqrt((v.n_chars - t.n_chars) * (v.n_chars - t.n_chars)
                    + (v.nonletter_share - t.nonletter_share) * (v.nonletter_share - t.nonletter_share)
                    + (v.word_share - t.word_share) * (v.word_share - t.word_share)), t.row_id) AS rk
      FROM v, tr t)
SELECT row_id, quality, CAST(avg(y) > 0.5 AS INTEGER) AS KNN_Prediction, round(avg(y), 6) AS KNN_Prob
FROM d WHERE rk <= 5 GROUP BY row_id, quality"""


@query("mod_knn", KNN_SQL, headline=True)
def mod_knn(spark, d):
    """5-NN, uniform vote, Euclidean on the three raw features (SQL brute force as oracle)."""
    train, val = _raw_split(spark, d)
    fitted = model("KNN", k=5).fit(train, F3, LABEL)
    return fitted.predict(val).select("row_id", LABEL, "KNN_Prediction", "KNN_Prob")


@query("mod_knn_distance")
def mod_knn_distance(spark, d):
    """kNN with distance weights and Manhattan metric on the prepared features."""
    return _val_predictions(spark, d, "KNN", k=7, weights="distance", metric="manhattan")


@query("mod_svm_poly")
def mod_svm_poly(spark, d):
    """SVM with the degree-3 polynomial kernel (exact monomial feature map), Platt probabilities."""
    return _val_predictions(spark, d, "SVM", kernel="poly")


@query("mod_stacking")
def mod_stacking(spark, d):
    p = prepared_task(spark, d)
    st = Stacking("Stacking", [model("NB"), model("Ridge")], folds=5).fit(p.train, p.features, LABEL)
    return st.predict(p.val).select("row_id", LABEL, "Stacking_Prediction", "Stacking_Prob")


# the vote is taken on probabilities as they are, before rounding
_NB_RAW = NB_SQL.replace("round(1 / (1 + exp(j0.jll - j1.jll)), 6)", "1 / (1 + exp(j0.jll - j1.jll))")


@query("mod_voting", f"""
SELECT row_id, quality, CAST((NB_Prob + KNN_Prob) / 2 > 0.5 AS INTEGER) AS Voting_Prediction,
       round((NB_Prob + KNN_Prob) / 2, 5) AS Voting_Prob
FROM (SELECT n.row_id, n.quality, n.NB_Prob, k.KNN_Prob FROM ({_NB_RAW}) n JOIN ({KNN_SQL}) k USING (row_id))""")
def mod_voting(spark, d):
    """Soft vote of naive Bayes and kNN on the raw features (probability to 5 places)."""
    train, val = _raw_split(spark, d)
    members = [model("NB").fit(train, F3, LABEL), model("KNN", k=5).fit(train, F3, LABEL)]
    out = Voting.of_fitted("Voting", members).predict(val)
    return out.select("row_id", LABEL, "Voting_Prediction", F.round("Voting_Prob", 5).alias("Voting_Prob"))


@query("mod_voting_models")
def mod_voting_models(spark, d):
    p = prepared_task(spark, d)
    members = [model(n).fit(p.train, p.features, LABEL) for n in ("NB", "KNN", "Ridge")]
    v = Voting.of_fitted("Voting", members)
    return v.predict(p.val).select("row_id", LABEL, "Voting_Prediction", "Voting_Prob")


@query("join_predictions", f"""
SELECT n.row_id, n.quality, n.NB_Prediction, n.NB_Prob, k.KNN_Prediction, k.KNN_Prob
FROM ({NB_SQL}) n JOIN ({KNN_SQL}) k USING (row_id)""")
def join_predictions(spark, d):
    """Two models' outputs side by side on one row per id."""
    train, val = _raw_split(spark, d)
    fitted = [model("NB").fit(train, F3, LABEL), model("KNN", k=5).fit(train, F3, LABEL)]
    return predict_all(val, fitted).select("row_id", LABEL, "NB_Prediction", "NB_Prob", "KNN_Prediction", "KNN_Prob")


@query("join_predictions_models")
def join_predictions_models(spark, d):
    """Several models' outputs side by side on one row per id (chained transforms, no join)."""
    p = prepared_task(spark, d)
    fitted = [model(n).fit(p.train, p.features, LABEL) for n in ("Ridge", "NB", "DecisionTree")]
    wide = predict_all(p.val, fitted)
    return wide.select("row_id", LABEL, *[c for n in ("Ridge", "NB", "DecisionTree")
                                          for c in (pred_col(n), prob_col(n))])


# --- 2.15 tuning and cross-validation --------------------------------------------------

def _search_table(spark, best, results):
    rows = [(i + 1, json.dumps(c, sort_keys=True), float(s), c == best) for i, (c, s) in enumerate(results)]
    return spark.createDataFrame(rows, "candidate int, params string, mean_auc double, is_best boolean")


_NB_GRID = [c["var_smoothing"] for c in grid("NB")]


@query("tun_grid", f"""
WITH {_nb_folds_sql(10, _NB_GRID)},
a AS (SELECT candidate, avg(auc) AS auc FROM {_auc_sql("SELECT *, candidate * 10 + fold AS cf FROM oof", "cf")}
      JOIN (SELECT DISTINCT candidate, candidate * 10 + fold AS cf FROM oof) USING (cf) GROUP BY candidate),
n AS (SELECT candidate, auc, unnest([{", ".join("'" + json.dumps({"var_smoothing": v}) + "'" for v in _NB_GRID)}]) AS params,
             unnest(range({len(_NB_GRID)})) AS i FROM a)
SELECT CAST(candidate + 1 AS INTEGER) AS candidate, params, round(auc, 6) AS mean_auc,
       row_number() OVER (ORDER BY auc DESC, candidate) = 1 AS is_best FROM n WHERE i = candidate""")
def tun_grid(spark, d):
    """Exhaustive grid for naive Bayes (5 smoothing values), 10 stratified folds, AUC: one aggregate."""
    p = prepared_task(spark, d)
    best, results, _ = search_cv(model("NB"), grid("NB"), p.train, p.features, LABEL, k=10)
    return _search_table(spark, best, results)


_KNN_GRID = grid("KNN")
_GAPS = [f"(a.x[{j}] - b.x[{j}])" for j in range(1, len(PREPARED_FEATURES) + 1)]
_KNN_CANDIDATES = ", ".join(f"({i}, {c['k']}, '{c['weights']}', '{c['metric']}', '{json.dumps(c, sort_keys=True)}')"
                            for i, c in enumerate(_KNN_GRID))


@query("tun_grid_knn", f"""
WITH {_folded_sql(10, True)},
di AS (SELECT a.row_id, a.quality AS y, a.fold, b.row_id AS rid, b.quality AS ny,
              unnest(['euclidean', 'manhattan']) AS metric,
              unnest([sqrt({" + ".join(f"{g} * {g}" for g in _GAPS)}), {" + ".join(f"abs({g})" for g in _GAPS)}]) AS d
       FROM fo a JOIN fo b ON a.fold <> b.fold),
nn AS (SELECT *, row_number() OVER (PARTITION BY metric, row_id ORDER BY d, rid) AS rk FROM di
       QUALIFY rk <= {max(c["k"] for c in _KNN_GRID)}),
ca(candidate, k, weights, metric, params) AS (VALUES {_KNN_CANDIDATES}),
oof AS (SELECT candidate, any_value(params) AS params, row_id, any_value(fold) AS fold, any_value(y) AS y,
               CASE WHEN any_value(weights) = 'uniform' THEN avg(ny) WHEN count(*) FILTER (WHERE d = 0) > 0 THEN avg(ny) FILTER (WHERE d = 0)
                    ELSE sum(CASE WHEN d > 0 THEN ny / d END) / sum(CASE WHEN d > 0 THEN 1 / d END) END AS prob
        FROM nn JOIN ca USING (metric) WHERE rk <= k GROUP BY candidate, row_id),
a AS (SELECT candidate, params, avg(auc) AS auc
      FROM {_auc_sql("SELECT *, candidate * 10 + fold AS cf FROM oof", "cf").replace("round(", "(").replace(", 6)", ")")}
      JOIN (SELECT DISTINCT candidate, params, candidate * 10 + fold AS cf FROM oof) USING (cf) GROUP BY candidate, params)
SELECT CAST(candidate + 1 AS INTEGER) AS candidate, params, round(auc, 6) AS mean_auc,
       row_number() OVER (ORDER BY auc DESC, candidate) = 1 AS is_best FROM a""")
def tun_grid_knn(spark, d):
    """Exhaustive grid for kNN (13 neighbour counts, 2 weightings, 2 metrics), 10 folds, AUC: one search a metric."""
    p = prepared_task(spark, d)
    best, results, _ = search_cv(model("KNN"), _KNN_GRID, p.train, p.features, LABEL, k=10)
    return _search_table(spark, best, results)


@query("tun_grid_forest")
def tun_grid_forest(spark, d):
    """22 of the forest's grid points (11 numbers of trees, depths 3 and 5), 3 folds, AUC: 6 fits instead of 66."""
    p = prepared_task(spark, d)
    points = [c for c in grid("RandomForest") if c["max_depth"] in (3, 5) and c["min_samples_leaf"] == 1]
    best, results, _ = search_cv(model("RandomForest"), points, p.train, p.features, LABEL, k=3)
    return _search_table(spark, best, results)


@query("tun_random")
def tun_random(spark, d):
    """Random search: 10 of the 25 elastic-net points (seed 42), 10 folds."""
    p = prepared_task(spark, d)
    best, results, _ = search_cv(model("ElasticNet"), grid("ElasticNet"), p.train, p.features, LABEL, k=10,
                                 search="random", n_iter=10, parallelism=4)
    return _search_table(spark, best, results)


@query("cv_metrics", f"""
WITH {_nb_folds_sql(10, [1e-9])},
m AS (SELECT m.fold, accuracy, precision, recall, f1, auc
      FROM {_metrics_sql("SELECT * FROM oof", "fold").replace("round(", "(").replace(", 6)", ")")} m
      JOIN {_auc_sql("SELECT * FROM oof", "fold").replace("round(", "(").replace(", 6)", ")")} a USING (fold))
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM (SELECT metric, value FROM m UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, auc))) GROUP BY metric""", headline=True)
def cv_metrics(spark, d):
    """10-fold accuracy / precision / recall / F1 / AUC: mean and population std."""
    p = prepared_task(spark, d)
    folded = add_folds(p.train, LABEL, 10)
    return cv_summary(fold_metrics(model("NB"), folded, p.features, LABEL, 10))


_PLS_OOF = f"""{_folded_sql(10, False)},
{_pls_sql("SELECT f.range AS grp, row_id, quality AS y, j, v FROM uf JOIN range(10) f ON uf.fold <> f.range")},
oof AS (SELECT row_id, y, CAST(prob >= 0.5 AS INTEGER) AS pred, prob
        FROM (SELECT uf.row_id, uf.quality AS y, any_value(ty.m) + any_value(ty.s) * sum(coef.b * (uf.v - coef.m) / coef.s) AS prob
              FROM uf JOIN coef ON coef.grp = uf.fold AND coef.j = uf.j JOIN ty ON ty.grp = uf.fold GROUP BY ALL))"""


@query("cv_predict", f"""
WITH {_PLS_OOF}
SELECT m.*, a.auc FROM {_metrics_sql("SELECT * FROM oof", None)} m, {_auc_sql("SELECT * FROM oof", None)} a""")
def cv_predict(spark, d):
    """PLS-DA out-of-fold predictions pooled, metrics computed once."""
    p = prepared_task(spark, d)
    folded = add_folds(p.train, LABEL, 10, stratified=False)
    return pooled_metrics(model("PLSDA"), folded, p.features, LABEL, 10)


# --- evaluation on the fixed scored table (SQL-checkable) --------------------------------

SCORED = fx.SQL_SCORED


SCORED_LONG = f"SELECT row_id, quality AS y, pred, score AS prob, lang FROM ({SCORED})"


@query("evl_confusion", f"SELECT * FROM {_metrics_sql(SCORED_LONG, None)}")
def evl_confusion(spark, d):
    return confusion_metrics(fx.scored(spark, d), LABEL, "pred")


@query("evl_auc", f"SELECT * FROM {_auc_sql(SCORED_LONG, 'lang')}", headline=True)
def evl_auc(spark, d):
    """Exact AUC (ties count one half) per language group."""
    return auc(fx.scored(spark, d), LABEL, "score", ["lang"])


_AUC_NULLS = f"""SELECT row_id, quality AS y, coalesce(nullif(lang, 'de'), '-') AS lang,
    CASE WHEN lang = 'fr' AND row_id % 3 = 0 THEN NULL ELSE score END AS prob FROM ({SCORED})"""


@query("evl_auc_nulls", f"SELECT nullif(lang, '-') AS lang, P, N, auc FROM {_auc_sql(_AUC_NULLS, 'lang')}")
def evl_auc_nulls(spark, d):
    """A group with NULL scores has no AUC and shifts no other group; the NULL group has one."""
    s = fx.scored(spark, d)
    holes = s.withColumn("score", F.when((F.col("lang") == "fr") & (F.col("row_id") % 3 == 0), F.lit(None)).otherwise(F.col("score")))
    return auc(holes.withColumn("lang", F.expr("nullif(lang, 'de')")), LABEL, "score", ["lang"])


@query("evl_auc_total", f"SELECT * FROM {_auc_sql(SCORED_LONG, None)}")
def evl_auc_total(spark, d):
    return auc(fx.scored(spark, d), LABEL, "score")


def _two_models(spark, d):
    s = fx.scored(spark, d)
    return s.select("row_id", LABEL, F.col("pred").alias("MD5_Prediction"), F.col("score").alias("MD5_Prob"),
                    (1 - F.col("pred")).alias("Flip_Prediction"), (1 - F.col("score")).alias("Flip_Prob"))


TWO_LONG = f"""
SELECT 'MD5' AS model, row_id, quality AS y, pred, score AS prob FROM ({SCORED})
UNION ALL SELECT 'Flip', row_id, quality, 1 - pred, 1 - score FROM ({SCORED})"""

VALIDATION_SQL = f"""
SELECT m.model, m.accuracy, m.precision, m.recall, m.f1, a.auc
FROM {_metrics_sql(TWO_LONG, 'model')} m JOIN {_auc_sql(TWO_LONG, 'model')} a USING (model)"""


@query("evl_validation", VALIDATION_SQL)
def evl_validation(spark, d):
    """One row per model: the five metrics from one grouped pass over long predictions."""
    return validation_table(_two_models(spark, d), ["MD5", "Flip"], LABEL)


@query("evl_test", f"SELECT *, auc < 0.5 AS auc_below_half FROM ({VALIDATION_SQL})")
def evl_test(spark, d):
    return test_table(_two_models(spark, d), ["MD5", "Flip"], LABEL)


@query("scr_metrics_log", f"""
SELECT model, metric, value FROM ({VALIDATION_SQL})
UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, auc))""")
def scr_metrics_log(spark, d):
    v = validation_table(_two_models(spark, d), ["MD5", "Flip"], LABEL)
    return v.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("accuracy", "precision", "recall", "f1", "auc")])).alias("e")).select("model", "e.metric", "e.value")


@query("evl_train_export")
def evl_train_export(spark, d):
    p = prepared_task(spark, d)
    fitted = model("Ridge").fit(p.train, p.features, LABEL)
    return train_export(fitted, p.train, p.features, LABEL, label_names={0: "low", 1: "high"})


@query("evl_train_export_nb", _nb_sql("NOT is_val", "j0.n_chars, j0.nonletter_share, j0.word_share, "))
def evl_train_export_nb(spark, d):
    """Training export of naive Bayes: id, features, target, prediction, probability (SQL-checked)."""
    train, _ = _raw_split(spark, d)
    fitted = model("NB").fit(train, F3, LABEL)
    return train_export(fitted, train, F3, LABEL)


@query("evl_train_export_pls", f"""
WITH {PLS_ALL}
SELECT row_id, {", ".join(f"round(pt.{c}, 6) AS {c}" for c in PREPARED_FEATURES)}, 1 - pt.quality AS quality,
       1 - CAST(score >= 0.5 AS INTEGER) AS PLSDA_Prediction, round(1 - score, 6) AS PLSDA_Prob
FROM sc JOIN pt USING (row_id) WHERE NOT pt.is_val""")
def evl_train_export_pls(spark, d):
    """PLS-DA training export, flipped: target, prediction and score turned around (1 - score)."""
    p = prepared_task(spark, d)
    fitted = model("PLSDA").fit(p.train, p.features, LABEL)
    return train_export(fitted, p.train, p.features, LABEL, flip=True)


_NB_TRAIN = f"({_nb_sql('NOT is_val')})"


@query("evl_train_export_flip", f"""
SELECT e.row_id, j.n_chars, j.nonletter_share, j.word_share, 1 - e.quality AS quality,
       1 - e.NB_Prediction AS NB_Prediction, round(1 - e.NB_Prob, 6) AS NB_Prob
FROM {_NB_TRAIN} e JOIN ({TASK}) j USING (row_id)""")
def evl_train_export_flip(spark, d):
    """Flipped training export of naive Bayes: target, prediction and probability turned around."""
    train, _ = _raw_split(spark, d)
    return train_export(model("NB").fit(train, F3, LABEL), train, F3, LABEL, flip=True)


_NB_FLIPPED_LONG = f"SELECT row_id, 1 - quality AS y, 1 - NB_Prediction AS pred, 1 - NB_Prob AS prob FROM {_NB_TRAIN}"


@query("evl_train_export_metrics", f"""
SELECT 'NB' AS model, m.accuracy, m.precision, m.recall, m.f1 FROM {_metrics_sql(_NB_FLIPPED_LONG, None)} m""")
def evl_train_export_metrics(spark, d):
    """Metrics of the flipped training export (its AUC is checked in the tests)."""
    train, _ = _raw_split(spark, d)
    export = train_export(model("NB").fit(train, F3, LABEL), train, F3, LABEL, flip=True)
    return train_export_metrics(export, "NB", LABEL).drop("auc")


@query("evl_models")
def evl_models(spark, d):
    """Validation table for four fitted models; the metrics of all come from one pass."""
    p = prepared_task(spark, d)
    names = ["Ridge", "NB", "DecisionTree", "PLSDA"]
    fitted = [model(n).fit(p.train, p.features, LABEL) for n in names]
    return validation_table(predict_all(p.val, fitted), names, LABEL)


# --- scoring a new table -----------------------------------------------------------------

SCR_PREPARE_SQL = f"""
WITH s AS {SPLIT}, tr AS (SELECT * FROM s WHERE NOT is_val),
st AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(nonletter_share) AS m2,
              stddev_pop(nonletter_share) AS s2, avg(word_share) AS m3, stddev_pop(word_share) AS s3 FROM tr)
SELECT a.row_id, a.quality,
       CASE WHEN a.lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lang_en,
       CASE WHEN a.lang = 'es' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lang_es,
       CASE WHEN a.lang = 'fr' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lang_fr,
       round((a.n_chars - st.m1) / CASE WHEN st.s1 > 0 THEN st.s1 ELSE 1 END, 6) AS n_chars,
       round((a.nonletter_share - st.m2) / CASE WHEN st.s2 > 0 THEN st.s2 ELSE 1 END, 6) AS nonletter_share,
       round((a.word_share - st.m3) / CASE WHEN st.s3 > 0 THEN st.s3 ELSE 1 END, 6) AS word_share
FROM ({fx.SQL_DOCS_NULLS}) a, st"""


@query("scr_prepare", SCR_PREPARE_SQL)
def scr_prepare(spark, d):
    """Every document replayed through the training recipe (target optional: NULL kept)."""
    p = prepared_task(spark, d)
    return p.recipe.apply(scoring_table(spark, d), with_label=False)


_ALL = f"SELECT row_id, n_chars, nonletter_share, word_share FROM ({fx.SQL_DOCS_NULLS})"
_NB_ALL = _nb_sql("NOT is_val").replace("(SELECT * FROM s WHERE NOT is_val) v", f"({_ALL}) v").replace(
    "SELECT v.row_id, v.quality, v.n_chars", "SELECT v.row_id, v.n_chars").replace("SELECT j0.row_id, j0.quality, ", "SELECT j0.row_id, ")


@query("scr_proba", f"SELECT row_id, NB_Prob FROM ({_NB_ALL})")
def scr_proba(spark, d):
    """Probability of the class coded 1 for every document (naive Bayes on the raw features)."""
    train, _ = _raw_split(spark, d)
    fitted = model("NB").fit(train, F3, LABEL)
    return fitted.predict(fx.docs_nulls(spark, d).select("row_id", *F3)).select("row_id", "NB_Prob")


@query("scr_predict", f"""
SELECT row_id, 1 - NB_Prediction AS NB_Prediction, round(1 - NB_Prob, 6) AS NB_Prob FROM ({_NB_ALL})""")
def scr_predict(spark, d):
    """Every document scored by naive Bayes, flipped."""
    train, _ = _raw_split(spark, d)
    fitted = model("NB").fit(train, F3, LABEL)
    wide = predict_all(fx.docs_nulls(spark, d).select("row_id", *F3), [fitted])
    return score_table(wide, ["NB"], flips={"NB": True}).select("row_id", "NB_Prediction", "NB_Prob")


@query("scr_predict_models")
def scr_predict_models(spark, d):
    """Score every document with three models; NB flipped; traffic light per model."""
    p = prepared_task(spark, d)
    names = ["Ridge", "NB", "PLSDA"]
    fitted = [model(n).fit(p.train, p.features, LABEL) for n in names]
    test = p.recipe.apply(scoring_table(spark, d), with_label=False)
    wide = predict_all(test, fitted)
    out = score_table(wide, names, flips={"NB": True})
    return out.select("row_id", *[c for n in names for c in (pred_col(n), prob_col(n), f"{n}_TrafficLight")])


@query("scr_proba_rf")
def scr_proba_rf(spark, d):
    """Probability of the class coded 1 for every document (random forest)."""
    p = prepared_task(spark, d)
    fitted = model("RandomForest").fit(p.train, p.features, LABEL)
    test = p.recipe.apply(scoring_table(spark, d), with_label=False)
    return fitted.predict(test).select("row_id", prob_col("RandomForest"))


@query("scr_long")
def scr_long(spark, d):
    """Long predictions (model, row_id, y, pred, prob) for the validation part."""
    p = prepared_task(spark, d)
    names = ["Ridge", "NB"]
    fitted = [model(n).fit(p.train, p.features, LABEL) for n in names]
    return long_predictions(predict_all(p.val, fitted), names, LABEL)


# --- 2.13 importances --------------------------------------------------------------------

@query("imp_rf")
def imp_rf(spark, d):
    p = prepared_task(spark, d, standardise=False)
    return imp.rf_importance(p.train, p.features, LABEL)


@query("imp_lasso")
def imp_lasso(spark, d):
    p = prepared_task(spark, d)
    return imp.lasso_importance(p.train, p.features, LABEL)


@query("imp_permutation")
def imp_permutation(spark, d):
    """Random forest fitted on the training part, 10 md5 shuffles per feature on validation."""
    p = prepared_task(spark, d, standardise=False)
    fitted = model("RandomForest", max_depth=imp.MAX_DEPTH).fit(p.train, p.features, LABEL)
    return imp.permutation_importance(fitted, p.val, p.features, LABEL, repeats=10)


def _mi_sql() -> str:
    mm = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in F3)
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, least(greatest(CAST(floor(({c} - a_{c}) / CASE WHEN b_{c} > a_{c} "
        f"THEN (b_{c} - a_{c}) / 10 ELSE 1.0 END) AS INTEGER), 0), 9) AS b, quality AS y FROM t, mm "
        f"WHERE {c} IS NOT NULL" for c in F3)
    return f"""
WITH t AS ({TASK}), mm AS (SELECT {mm} FROM t), long AS ({parts}),
c AS (SELECT feature, b, y, count(*) AS n FROM long WHERE y IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nt, sum(n) OVER (PARTITION BY feature, b) AS nb,
             sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
SELECT 'mutual_info' AS method, feature, round(sum(n / nt * ln(n * nt / (nb * ny))), 6) AS importance
FROM w GROUP BY feature"""


# whole numbers: the shares have six decimals
MI_SCALE = {"n_chars": 1, "nonletter_share": 1_000_000, "word_share": 1_000_000}


def _mi_neighbors_sql(k: int = 3) -> str:
    """Every pair of rows: the k-th distance inside the class, the rows nearer than that, harmonic numbers summed up."""
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, row_id, quality AS y, round({c} * {s}) AS x FROM t" for c, s in MI_SCALE.items())
    return f"""
WITH t AS ({TASK}), l AS ({parts}),
h AS (SELECT i, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i), 0) AS h FROM range(1, (SELECT count(*) + 1 FROM t)) r(i)
      UNION ALL SELECT 0, 0),
n AS (SELECT feature, y, count(*) AS n FROM l GROUP BY ALL),
d AS (SELECT a.feature, a.row_id, a.y, a.x, abs(a.x - b.x) AS d,
             row_number() OVER (PARTITION BY a.feature, a.row_id ORDER BY abs(a.x - b.x)) AS nth
      FROM l a JOIN l b ON a.feature = b.feature AND a.y = b.y AND a.row_id <> b.row_id),
r AS (SELECT d.feature, d.row_id, d.y, d.x, d.d AS r, n.n, d.nth AS k FROM d JOIN n USING (feature, y) WHERE nth = least({k}, n.n - 1)),
m AS (SELECT r.feature, r.row_id, r.n, r.k, count(*) AS m FROM r JOIN l ON l.feature = r.feature
      AND CASE WHEN r.r = 0 THEN l.x = r.x ELSE abs(l.x - r.x) < r.r END GROUP BY ALL),
i AS (SELECT feature, count(*) AS rows, avg(hk.h - hn.h - hm.h) AS mean FROM m JOIN h hk ON hk.i = m.k - 1 JOIN h hn ON hn.i = m.n - 1
      JOIN h hm ON hm.i = m.m - 1 GROUP BY feature)
SELECT 'mutual_info' AS method, feature, round(greatest(0, h.h + mean), 6) AS importance FROM i JOIN h ON h.i = rows - 1"""


@query("imp_mutual_info", _mi_neighbors_sql())
def imp_mutual_info(spark, d):
    """Mutual information of each feature and the target by three nearest neighbours."""
    t = fx.docs_task(spark, d)
    scaled = t.select(LABEL, *[F.round(F.col(c) * s).alias(c) for c, s in MI_SCALE.items()])
    return neighbor_information(scaled, list(MI_SCALE), LABEL, k=3)


@query("imp_mutual_info_width", _mi_sql())
def imp_mutual_info_width(spark, d):
    """Plug-in mutual information on 10 equal-width bins."""
    return imp.mutual_information(fx.docs_task(spark, d), F3, LABEL, bins=10)


def _mi_quantile_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(floor((row_number() OVER (ORDER BY {c}, row_id) - 1) * 10 "
        f"/ count(*) OVER ()) AS INTEGER) AS b, quality AS y FROM t WHERE {c} IS NOT NULL AND quality IS NOT NULL"
        for c in F3)
    return f"""
WITH t AS ({TASK}), long AS ({parts}),
c AS (SELECT feature, b, y, count(*) AS n FROM long GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nt, sum(n) OVER (PARTITION BY feature, b) AS nb,
             sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
SELECT 'mutual_info' AS method, feature, round(sum(n / nt * ln(n * nt / (nb * ny))), 6) AS importance
FROM w GROUP BY feature"""


@query("imp_mutual_info_quantile", _mi_quantile_sql())
def imp_mutual_info_quantile(spark, d):
    """Plug-in MI on 10 equal-frequency bins (exact ranks, ties broken by row id)."""
    return imp.mutual_information(fx.docs_task(spark, d), F3, LABEL, bins=10, binning="quantile")


def _all_importances(spark, d):
    p = prepared_task(spark, d, standardise=False)
    return (imp.rf_importance(p.train, p.features, LABEL)
            .unionByName(imp.lasso_importance(p.train, p.features, LABEL))
            .unionByName(imp.mutual_information(p.train, p.features, LABEL)))


_MI_RANKED = f"""SELECT method, feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank
FROM ({_mi_sql()})"""


@query("imp_table_models")
def imp_table_models(spark, d):
    """(method, feature, importance, rank) for three methods, top 10 each."""
    return imp.ranked(_all_importances(spark, d), top=10)


@query("srt_importance_rf")
def srt_importance_rf(spark, d):
    p = prepared_task(spark, d, standardise=False)
    return imp.global_rank(imp.rf_importance(p.train, p.features, LABEL))


@query("srt_top10_rf")
def srt_top10_rf(spark, d):
    """The ten largest random-forest importances (a top-k report)."""
    p = prepared_task(spark, d, standardise=False)
    return imp.global_rank(imp.rf_importance(p.train, p.features, LABEL)).where(F.col("rank") <= 10)



@query("imp_table", f"SELECT method, feature, importance, rank FROM ({_MI_RANKED})")
def imp_table(spark, d):
    """(method, feature, importance, rank): mutual information, top 10."""
    return imp.ranked(imp.mutual_information(fx.docs_task(spark, d), F3, LABEL, bins=10), top=10)


@query("srt_importance", f"SELECT method, feature, importance, rank FROM ({_MI_RANKED})")
def srt_importance(spark, d):
    return imp.global_rank(imp.mutual_information(fx.docs_task(spark, d), F3, LABEL, bins=10))


@query("srt_top10", f"SELECT method, feature, importance, rank FROM ({_MI_RANKED}) WHERE rank <= 10")
def srt_top10(spark, d):
    """The ten largest importances (a top-k report)."""
    return imp.global_rank(imp.mutual_information(fx.docs_task(spark, d), F3, LABEL, bins=10)).where(F.col("rank") <= 10)


# --- streaming -----------------------------------------------------------------------------

@query("stream_score")
def stream_score(spark, d):
    """Every document scored through a file stream (recipe + ridge + naive Bayes)."""
    from tricolor.streaming.score_stream import score_files
    p = prepared_task(spark, d)
    fitted = [model(n).fit(p.train, p.features, LABEL) for n in ("Ridge", "NB")]
    out = score_files(spark, scoring_table(spark, d), p.recipe, fitted, flips={"NB": False})
    return out.select("row_id", *[c for n in ("Ridge", "NB") for c in (pred_col(n), prob_col(n), f"{n}_TrafficLight")])


# --- 2.10 grid builders ----------------------------------------------------------------------

def _grid_sql(value: str, where: str) -> str:
    return f"""
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE {where})
SELECT CAST(i AS INTEGER) AS point, round({value}, 6) AS value FROM b, range(10) r(i)"""


@query("fn_logspace", _grid_sql("exp(ln(lo) + (ln(hi) - ln(lo)) * i / 9)", "l_extendedprice > 0"))
def fn_logspace(spark, d):
    """Ten log-spaced points over the positive range of a column."""
    return value_grid(table(spark, d, "lineitem"), "l_extendedprice", 10, log=True)


@query("fn_linspace", _grid_sql("lo + (hi - lo) * i / 9", "true"))
def fn_linspace(spark, d):
    """Ten evenly spaced points over the range of a column."""
    return value_grid(table(spark, d, "lineitem"), "l_extendedprice", 10)
