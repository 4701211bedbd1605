"""Quality classifier: hierarchical empirical Bayes over sites and their sections.

A logistic classifier on the text measures gives each document its own evidence. The evidence is
summed per section (host, path) and per host in grouped aggregates. Prior strengths come from the
data: the between-group variance is estimated by moments, and a group of n documents keeps
n / (n + strength) of its own mean, so sparse sections fall back to their host and sparse hosts to
the global prior. A document's posterior joins its own log odds with its section's, itself left
out, relative to the global prior.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.llm.common import stage_table
from tricolor.llm.quality_rules import measures

# Evidence of the document itself: SQL over the measures of its text.
EVIDENCE = ("ln(1 + n_words)", "coalesce(try_divide(word_chars, n_words), 0)", "coalesce(try_divide(n_symbols, n_words), 0)",
            "coalesce(try_divide(n_upper, word_chars), 0)", "coalesce(try_divide(n_stop_words, n_words), 0)",
            "coalesce(try_divide(n_dup_lines, n_lines), 0)", "coalesce(try_divide(n_repeat_words, n_words), 0)")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(weights, bias, means, scales): ridge logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, pen = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 0.5 * (1 + np.tanh(0.5 * np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(h, z.T @ (p - y) + pen * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1]), mean, scale


def _strength(groups: DataFrame, parent: str) -> float:
    """Documents' worth of the prior: within-group over between-group variance, by moments."""
    r = (groups.withColumn("_d", F.pow(F.col("_s") / F.col("_n") - F.col(parent), 2) * F.col("_n"))
         .agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum("_d").alias("between"),
              F.sum(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")).alias("within"),
              F.sum(F.col("_n") * F.col("_n")).alias("nn")).first())
    n, g = r["n"] or 0, r["g"] or 0
    if n <= g or g < 2:
        return 1.0
    within = max(r["within"] / (n - g), 1e-6)
    between = max((r["between"] - (g - 1) * within) / (n - r["nn"] / n), 1e-6)
    return min(max(within / between, 1.0), 1e6)


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 path_col: str = "lang", label_col: str = "quality", most_labelled: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: (id, evidence, host_rate, path_rate, posterior, kept).

    ``evidence`` is the classifier's probability of a good document, learned from at most about
    ``most_labelled`` labelled rows (drawn by a hash of the id); ``host_rate`` and ``path_rate`` are
    the shrunken shares of good documents of the host and of its section, the latter without the
    document itself; ``kept`` is posterior >= 0.5.

    Edge cases: null and empty texts have the evidence of a text without words; null hosts and
    paths are a host and a section of their own; without labels of both kinds the evidence is 0.5
    for all; null ids and repeated rows are scored like others; an empty table gives an empty
    result. Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(path_col).cast("string").alias("_path"),
                       F.col(text_col).alias("_text"))
    m = measures(base, "_text", ("_id", "_host", "_path"))
    x = stage_table(m.select("_id", "_host", "_path", F.array(*[F.expr(e).cast("double") for e in EVIDENCE]).alias("_x")), "evidence")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit(41)), F.lit(1 << 20)) < int(min(1.0, most_labelled / max(1, n)) * (1 << 20)))
    rows = x.join(drawn, "_id").select("_x", "_y").collect()
    y = np.array([r["_y"] for r in rows], float)
    if len(rows) and 0 < y.mean() < 1:
        w, bias, mean, scale = fit_logistic(np.array([r["_x"] for r in rows], float), y)
        z = F.lit(bias)
        for i in range(len(w)):
            z = z + (F.col("_x")[i] - float(mean[i])) * float(w[i] / scale[i])
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(20.0)), F.lit(-20.0))))
    else:
        p = F.lit(0.5)
    p = F.greatest(F.least(p, F.lit(0.999)), F.lit(0.001))
    scored = stage_table(x.select("_id", "_host", "_path", p.alias("_p")), "scored")
    sums = [F.sum("_p").alias("_s"), F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col("_p") * F.col("_p")).alias("_q")]
    paths = stage_table(scored.groupBy("_host", "_path").agg(*sums), "paths")
    hosts = paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in ("_s", "_n", "_q")])
    prior = scored.agg(F.avg("_p")).first()[0]
    prior = 0.5 if prior is None else float(prior)
    k1 = _strength(hosts.withColumn("_m", F.lit(prior)), "_m")
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.col("_s") + k1 * prior) / (F.col("_n") + k1)).alias("host_rate"))
    paths = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_h"])).drop("_h")
    k2 = _strength(paths, "host_rate")
    groups = stage_table(paths.select(F.col("_host").alias("_h"), F.col("_path").alias("_l"), "_s", "_n", "host_rate"), "groups")
    joined = scored.join(groups, scored["_host"].eqNullSafe(groups["_h"]) & scored["_path"].eqNullSafe(groups["_l"]))
    rate = (F.col("_s") - F.col("_p") + k2 * F.col("host_rate")) / (F.col("_n") - 1 + k2)
    odds = lambda c: F.ln(c / (1 - c))
    logit = odds(F.col("_p")) + odds(F.col("path_rate")) - F.lit(float(np.log(prior / (1 - prior))))
    return (joined.withColumn("path_rate", rate).withColumn("posterior", 1 / (1 + F.exp(-logit)))
            .select(F.col("_id").alias(id_col), F.col("_p").alias("evidence"), "host_rate", "path_rate", "posterior",
                    (F.col("posterior") >= 0.5).alias("kept")))
