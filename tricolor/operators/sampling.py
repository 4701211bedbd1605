"""Train/validation split, cross-validation folds and class rebalancing.

All randomness is md5 of ``'<seed>:' || row_id`` (see ``functions.hashing``), so the chosen
rows do not depend on partitioning and the SQL oracle reproduces them. Splits and under-sampling
select by a key cutoff that is found by counting (``operators.cutoff``); where every row needs its
rank (folds, draws), it comes from the range-partitioned ``ordered_rank`` / ``rank_within``
helpers, never a global window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.functions.hashing import hash_int, hash_key, hash_uniform
from tricolor.operators.cutoff import class_cutoffs, cutoff
from tricolor.operators.neighbors import knn
from tricolor.operators.profile import q
from tricolor.sources.rowid import ordered_rank, rank_within

DEFAULT_SEED = 42


def split_train_val(df: DataFrame, val_fraction: float = 0.2, seed: int = DEFAULT_SEED,
                    id_col: str = "row_id") -> DataFrame:
    """Adds ``is_val``: the first ceil(n * f) rows in md5 order are validation (exact size)."""
    if not 0.0 < val_fraction < 1.0:
        raise ValueError("val_fraction must lie in (0, 1)")
    key, id_ = hash_key(seed, q(id_col)), q(id_col)
    _, cut = cutoff(df, key, id_, lambda n: math.ceil(n * val_fraction))
    return df.select(*[q(c) for c in df.columns], cut.holds(key, id_).alias("is_val"))


def class_rank(df: DataFrame, label: str, seed: int = DEFAULT_SEED, id_col: str = "row_id",
               out: str = "class_rank") -> DataFrame:
    """1..n_c inside each class in md5 order (few classes of any size)."""
    return rank_within(df, label, [hash_key(seed, q(id_col)), q(id_col)], out)


def stratified_folds(df: DataFrame, label: str, k: int = 10, seed: int = DEFAULT_SEED,
                     id_col: str = "row_id", out: str = "fold") -> DataFrame:
    """fold = (rank within class - 1) % k: every fold gets each class to within one row."""
    r = class_rank(df, label, seed, id_col, "_tc_crank")
    return r.select(*[q(c) for c in df.columns], ((F.col("_tc_crank") - 1) % k).cast("int").alias(out))


def plain_folds(df: DataFrame, k: int = 10, seed: int = DEFAULT_SEED, id_col: str = "row_id",
                out: str = "fold") -> DataFrame:
    r = ordered_rank(df, [hash_key(seed, q(id_col)), q(id_col)], "_tc_rank")
    return r.select(*[q(c) for c in df.columns], ((F.col("_tc_rank") - 1) % k).cast("int").alias(out))


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class of a target that has passed the two-value check (a row per class)."""
    return {r["c"]: r["n"] for r in df.groupBy(q(label).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}


def under_sample(df: DataFrame, label: str, seed: int = DEFAULT_SEED, id_col: str = "row_id") -> DataFrame:
    """Every class cut to the minority count, without replacement, md5 order."""
    key, id_ = hash_key(seed, q(id_col)), q(id_col)
    _, cuts = class_cutoffs(df, key, id_, q(label), lambda n: dict.fromkeys(n, min(n.values(), default=0)))
    keep = F.lit(False)
    for cls, cut in cuts.items():
        keep = keep | (q(label).eqNullSafe(F.lit(cls)) & cut.holds(key, id_))
    return df.where(keep)


def _max_id(df: DataFrame, id_col: str) -> int:
    return df.agg(F.max(q(id_col))).first()[0] or 0


def over_sample(df: DataFrame, label: str, seed: int = DEFAULT_SEED, id_col: str = "row_id",
                max_id: int | None = None) -> DataFrame:
    """Minority classes drawn with replacement up to the majority count.

    Draw ``j`` in ``[0, need)`` (a distributed ``range``) picks minority rank
    ``hash(seed, class:j) mod n_c + 1``; draws join the ranked minority rows on the rank.
    New rows get ids after ``max_id`` (the largest id in use anywhere, validation rows included;
    by default that of ``df``) and ``is_synthetic = true``.
    """
    counts = class_counts(df, label)
    n_max = max(counts.values())
    base_id = _max_id(df, id_col) if max_id is None else max_id
    r = class_rank(df, label, seed, id_col, "_tc_crank")
    spark = df.sparkSession
    out = df.withColumn("is_synthetic", F.lit(False))
    offset = 0
    for cls in sorted(counts, key=lambda v: (v is None, v)):
        need = n_max - counts[cls]
        if need <= 0:
            continue
        draws = spark.range(need).select(
            F.col("id").alias("_tc_j"),
            (F.pmod(hash_int(f"{seed}:over:{cls}", F.col("id")), F.lit(counts[cls])) + 1).alias("_tc_crank"))
        picked = r.where(q(label) == F.lit(cls)).join(draws, "_tc_crank")
        picked = picked.select(*[(F.lit(base_id + offset + 1) + F.col("_tc_j")).cast(df.schema[id_col].dataType).alias(c)
                                 if c == id_col else q(c) for c in df.columns],
                               F.lit(True).alias("is_synthetic"))
        out = out.unionByName(picked)
        offset += need
    return out


def smote(df: DataFrame, label: str, features: list[str], k: int = 5, seed: int = DEFAULT_SEED,
          id_col: str = "row_id", block_rows: int = 20_000, max_id: int | None = None) -> DataFrame:
    """SMOTE (Chawla et al. 2002): minority rows x + u * (nn - x), nn among its k nearest
    minority neighbours (exact blocked kNN, ties by id; ``row_id`` is not a feature).

    Draw ``j`` picks a base by rank, one of its k neighbours and u in [0, 1) from md5.
    """
    counts = class_counts(df, label)
    n_max = max(counts.values())
    base_id = _max_id(df, id_col) if max_id is None else max_id
    spark = df.sparkSession
    out = df.select(*[q(c) for c in df.columns], F.lit(False).alias("is_synthetic"))
    offset = 0
    vec = F.array(*[q(c).cast("double") for c in features])
    for cls in sorted(counts, key=lambda v: (v is None, v)):
        need = n_max - counts[cls]
        if need <= 0:
            continue
        minority = df.where(q(label) == F.lit(cls)).select(q(id_col).alias("_tc_id"), vec.alias("_tc_vec"))
        n_c = counts[cls]
        kk = min(k, n_c - 1)
        if kk < 1:
            raise ValueError("SMOTE needs at least two rows in every minority class")
        nn = knn(minority, minority, kk, "_tc_id", "_tc_vec", "_tc_id", "_tc_vec",
                 exclude_self=True, block_rows=block_rows,
                 payload={"_tc_vec": "array<double>"})
        ranked = rank_within(minority.withColumn("_tc_c", F.lit(0)), "_tc_c",
                             [hash_key(seed, F.col("_tc_id")), F.col("_tc_id")], "_tc_crank")
        draws = spark.range(need).select(
            F.col("id").alias("_tc_j"),
            (F.pmod(hash_int(f"{seed}:smote:{cls}", F.col("id")), F.lit(n_c)) + 1).alias("_tc_crank"),
            (F.pmod(hash_int(f"{seed}:smote-nn:{cls}", F.col("id")), F.lit(kk)) + 1).alias("nn_rank"),
            hash_uniform(f"{seed}:smote-gap:{cls}", F.col("id")).alias("_tc_u"))
        base = draws.join(ranked.select("_tc_crank", F.col("_tc_id").alias("qid"), F.col("_tc_vec").alias("_tc_x")),
                          "_tc_crank")
        withnn = base.join(nn.select("qid", "nn_rank", F.col("_tc_vec").alias("_tc_n")), ["qid", "nn_rank"])
        synth = withnn.select(
            "_tc_j", *[(F.col("_tc_x")[i] + F.col("_tc_u") * (F.col("_tc_n")[i] - F.col("_tc_x")[i])).alias(f)
                       for i, f in enumerate(features)])
        cols = []
        for c in df.columns:
            if c == id_col:
                cols.append((F.lit(base_id + offset + 1) + F.col("_tc_j")).cast(df.schema[id_col].dataType).alias(c))
            elif c == label:
                cols.append(F.lit(cls).cast(df.schema[label].dataType).alias(c))
            elif c in features:
                cols.append(F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c))
            else:
                cols.append(F.lit(None).cast(df.schema[c].dataType).alias(c))
        out = out.unionByName(synth.select(*cols, F.lit(True).alias("is_synthetic")))
        offset += need
    return out
