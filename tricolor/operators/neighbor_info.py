"""Mutual information of continuous features and a class label by nearest neighbours (Ross 2014).

For every value: the distance to its k-th nearest neighbour inside its class, and the number m of
rows of any class nearer than that. With N rows, n of them in the row's class,
``I = psi(N) + <psi(k)> - <psi(n)> - <psi(m)>``, at least 0.

1. Equal values of a class are one row with a count before anything is sorted.
2. Neighbours: the values of all features and classes are numbered in one distributed order; runs of
   ``RUN`` numbers, each with ``k`` rows of the runs beside it (the halo), are windows of their own.
   A run has a fixed size, so that k neighbours on either side are always inside it.
3. Counts: the two ends of every value's interval are sorted in among the values, and the rows
   below an end are a distributed running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tricolor.operators.profile import q
from tricolor.sources.rowid import ordered_rank, ordered_running_sum

RUN = 1 << 16
EULER_GAMMA = 0.5772156649015329
SUMMED = 64      # harmonic numbers up to here are sums, beyond it a series (error under 1e-13)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n (0 for n = 0)."""
    sums = [0.0]
    for i in range(1, SUMMED + 1):
        sums.append(sums[-1] + 1.0 / i)
    x = n.cast("double")
    series = F.log(x) + EULER_GAMMA + 1.0 / (2 * x) - 1.0 / (12 * x * x) + 1.0 / (120 * x * x * x * x)
    return F.when(n <= SUMMED, F.element_at(F.array(*[F.lit(s) for s in sums]), (F.least(n, F.lit(SUMMED)) + 1).cast("int"))).otherwise(series)


def _values(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(f, y, x, c, n): distinct finite values with their rows and the rows of their class; rows that
    are alone in their class have no neighbour and take no part."""
    each = F.array(*[F.struct(F.lit(i).alias("f"), q(c).cast("double").alias("x")) for i, c in enumerate(features)])
    long = df.where(q(label).isNotNull()).select(q(label).alias("y"), F.inline(each))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    # + 0.0: the two zeros are one value
    counts = long.where(finite).groupBy("f", "y", (F.col("x") + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    classes = counts.groupBy("f", "y").agg(F.sum("c").alias("n")).where("n > 1")
    return counts.join(classes, ["f", "y"])


def radii(values: DataFrame, k: int) -> DataFrame:
    """``values`` with ``k`` (fewer in small classes) and ``radius``, the distance to the k-th neighbour."""
    ranked = ordered_rank(values, ["f", "y", "x"], "r")
    run, at = F.floor((F.col("r") - 1) / RUN), (F.col("r") - 1) % RUN
    halo = F.concat(F.array(run), F.when(at < k, F.array(run - 1)).otherwise(F.array().cast("array<bigint>")),
                    F.when(at >= RUN - k, F.array(run + 1)).otherwise(F.array().cast("array<bigint>")))
    w = Window.partitionBy("run").orderBy("r")
    there = F.struct("f", "y", "x", "c")
    shifted = ranked.select("*", run.alias("home"), F.explode(halo).alias("run")).select(
        "*", *[f(there, i).over(w).alias(f"{name}{i}") for i in range(1, k + 1) for f, name in ((F.lag, "before"), (F.lead, "after"))])

    def neighbour(c: str) -> Column:
        same = (F.col(f"{c}.f") == F.col("f")) & (F.col(f"{c}.y") == F.col("y"))
        return F.when(same, F.struct(F.abs(F.col(f"{c}.x") - F.col("x")).alias("d"), F.col(f"{c}.c").alias("c")))

    near = F.array_compact(F.array(F.struct(F.lit(0.0).alias("d"), (F.col("c") - 1).alias("c")),
                                   *[neighbour(f"{s}{i}") for i in range(1, k + 1) for s in ("before", "after")]))
    wanted = F.least(F.lit(k).cast("bigint"), F.col("n") - 1)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0.0).alias("radius"))
    reach = F.aggregate(F.array_sort(near), start, lambda a, x: F.struct(
        (a["seen"] + x["c"]).alias("seen"), F.when(a["seen"] < wanted, x["d"]).otherwise(a["radius"]).alias("radius")))
    return shifted.where("run = home").select("f", "y", "x", "c", "n", wanted.alias("k"), reach["radius"].alias("radius"))


def neighbor_information(df: DataFrame, features: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """(method, feature, importance) in nats. NULL and non-finite values and NULL labels are left out;
    ties are taken as they are (no noise is added). Distances are compared as doubles: give values
    whose sums are exact (whole numbers, say) where a tie at the radius must not depend on rounding."""
    found = radii(_values(df, features, label), k)
    data = found.groupBy("f", F.col("x").alias("v")).agg(F.sum("c").alias("w"))
    # at equal places: ends that exclude the values there (0), the values (1), ends that include them (2)
    tie = F.col("radius") == 0
    end = lambda sign: F.struct(F.lit(sign).alias("sign"), (F.col("x") + sign * F.col("radius")).alias("v"),
                                F.when(tie == F.lit(sign > 0), 2).otherwise(0).alias("kind"))
    ends = found.select("f", "y", "x", "c", "n", "k", F.inline(F.array(end(1), end(-1))))
    keys = ("y", "x", "c", "n", "k", "sign")
    types = dict(found.dtypes) | {"sign": "int"}
    events = (ends.withColumn("w", F.lit(0).cast("bigint"))
              .unionByName(data.select("f", "v", "w", F.lit(1).alias("kind"), *[F.lit(None).cast(types[c]).alias(c) for c in keys])))
    below = ordered_running_sum(events, ["f", "v", "kind", "y", "x", "sign"], ["w"], prefix="upto_").where("kind <> 1")
    inside = below.groupBy("f", "y", "x", "c", "n", "k").agg(F.sum(F.col("sign") * F.col("upto_w")).alias("m"))
    part = harmonic(F.col("k") - 1) - harmonic(F.col("n") - 1) - harmonic(F.col("m") - 1)
    per = inside.groupBy("f").agg(F.sum("c").alias("rows"), (F.sum(F.col("c") * part) / F.sum("c")).alias("mean"))
    names = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("f") + 1)
    return per.select(F.lit("mutual_info").alias("method"), names.alias("feature"),
                      F.greatest(F.lit(0.0), harmonic(F.col("rows") - 1) + F.col("mean")).alias("importance"))
