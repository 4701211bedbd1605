"""Profiling aggregates: shape, types, missing values, counts, describe, correlation,
quantiles, histograms, box plots and scatter points.

Each statistic family is one ``agg`` (one pass); only fitted constants reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricolor.functions.hashing import hash_key


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ("row_id",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ("row_id",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def boolean_columns(df: DataFrame, exclude: Sequence[str] = ("row_id",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.BooleanType) and f.name not in exclude]


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols) as one row; the count is the only job."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def dtypes(df: DataFrame) -> DataFrame:
    """(position, column, dtype) from the schema."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def dtype_freq(df: DataFrame) -> DataFrame:
    return (dtypes(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))
            .orderBy(F.desc("n_columns"), "dtype"))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long table (column, missing, pct_missing) for every column, one pass.

    ``pct_missing`` = 100 * missing / rows, rounded to 2 places.
    """
    cols = list(columns) if columns else df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', m{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("_n", f"stack({len(cols)}, {stack}) AS (column, missing)")
    return long.select(
        "column", F.col("missing").cast("bigint").alias("missing"),
        F.round(F.try_divide(F.col("missing") * F.lit(100.0), F.col("_n")), 2).alias("pct_missing"))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Only columns with missing > 0, most missing first."""
    return (missing_counts(df, columns).where(F.col("missing") > 0)
            .orderBy(F.desc("missing"), "column"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value -> count, most frequent first; NULLs excluded."""
    return (df.where(q(column).isNotNull()).groupBy(q(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value"))


def describe(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, p25, p50, p75, max and median of one column."""
    x = q(column).cast("double")
    p25, p50, p75 = quantile_values(df, column, (0.25, 0.5, 0.75), exact)
    agg = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                 F.min(x).alias("min"), F.max(x).alias("max"))
    lit = lambda v: F.lit(v).cast("double")
    return agg.select(F.lit(column).alias("column"), "count", "mean", "std", "min",
                      lit(p25).alias("p25"), lit(p50).alias("p50"), lit(p75).alias("p75"), "max",
                      lit(p50).alias("median"))


def corr2(df: DataFrame, x: str, y: str, where: Column | None = None) -> DataFrame:
    """Pearson correlation of two columns, optionally filtered (by target or category)."""
    d = df.where(where) if where is not None else df
    return d.agg(F.corr(q(x).cast("double"), q(y).cast("double")).alias("corr"),
                 F.count_if(q(x).isNotNull() & q(y).isNotNull()).alias("n_pairs"))


# Columns whose pairs (36) still are expressions of one aggregate.
NATIVE_PAIRED = 8


def corr_matrix(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Pearson matrix in long form (col_a, col_b, corr); NULLs are skipped pairwise.

    Up to ``NATIVE_PAIRED`` columns: one aggregate of p(p+1)/2 ``corr`` states, the mirror half a projection. With
    more columns that many expressions would not compile: the blocked Gram aggregate takes over.
    """
    d = df.where(where) if where is not None else df
    cols = list(columns)
    if len(cols) > NATIVE_PAIRED:
        from tricolor.operators.gram import correlations
        return correlations(d, cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = d.agg(*[F.corr(q(cols[i]).cast("double"), q(cols[j]).cast("double")).alias(f"c{i}_{j}")
                   for i, j in pairs])
    entries = []
    for i, j in pairs:
        entries.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                                F.col(f"c{i}_{j}").alias("corr")))
        if i != j:
            entries.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"),
                                    F.col(f"c{i}_{j}").alias("corr")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Linear-interpolation quantiles (position (n - 1) p, as Spark and DuckDB) of every column.

    One plan at every size: rows become (column, value) counts, pre-aggregated before the shuffle
    (a value that is most of a column is one row), the counts are summed up in value order by the
    range-partitioned running sum, and the values that hold the wanted positions are read off: at
    most two per probability and column reach the driver.
    """
    from tricolor.sources.rowid import ordered_running_sum
    names = list(columns)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), q(c).cast("double").alias("v")) for i, c in enumerate(names)])
    counts = (df.select(F.explode(cells).alias("e")).select("e.c", "e.v").where(F.col("v").isNotNull())
              .groupBy("c", "v").agg(F.count(F.lit(1)).alias("k")))
    cum = ordered_running_sum(counts, [F.col("c"), F.col("v")], ["k"], prefix="cum_")
    sizes = cum.groupBy("c").agg(F.sum("k").alias("n"), F.min(F.col("cum_k") - F.col("k")).alias("start"))
    h = (F.col("n") - 1) * F.col("p")
    # one row per column, probability and side: bounded by the schema, not by the rows
    wanted = (sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in dict.fromkeys(probs)])))
              .select("c", "p", (h - F.floor(h)).alias("w"),
                      F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(h).alias("at")),
                                        F.struct(F.lit(1).alias("side"), F.ceil(h).alias("at")))).alias("x"), "start")
              .select(F.col("c").alias("wc"), "p", "w", "x.side", (F.col("x.at") + F.col("start")).alias("at")))
    hit = cum.join(F.broadcast(wanted), (F.col("c") == F.col("wc")) & (F.col("at") >= F.col("cum_k") - F.col("k"))
                   & (F.col("at") < F.col("cum_k"))).select("c", "p", "w", "side", "v").collect()
    ends = {(r["c"], r["p"], r["side"]): (r["v"], r["w"]) for r in hit}
    out = {}
    for i, c in enumerate(names):
        out[c] = [None if (i, float(p), 0) not in ends else
                  ends[i, float(p), 0][0] + ends[i, float(p), 0][1] * (ends[i, float(p), 1][0] - ends[i, float(p), 0][0]) for p in probs]
    return out


def quantile_values(df: DataFrame, column: str, probs: Sequence[float] = (0.25, 0.75),
                    exact: bool = True) -> list:
    """Quantiles of one column as constants; ``exact=False`` uses ``percentile_approx``."""
    if not exact:
        r = df.agg(F.percentile_approx(q(column).cast("double"), list(probs), 10000).alias("_q")).first()["_q"]
        return [None] * len(probs) if r is None else [float(v) for v in r]
    return quantile_table(df, [column], probs)[column]


def quantiles(df: DataFrame, column: str, probs: Sequence[float] = (0.25, 0.75),
              exact: bool = True) -> DataFrame:
    """One row of quantiles named ``q25``, ``q75``, ..."""
    vals = quantile_values(df, column, probs, exact)
    names = [f"q{int(round(p * 100))}" for p in probs]
    return df.sparkSession.createDataFrame([tuple(vals)], ", ".join(f"{n} double" for n in names))


def iqr_fences(df: DataFrame, column: str, k: float = 1.5, exact: bool = True) -> tuple[float, float, float, float]:
    """(q1, q3, lower fence, upper fence) as fitted constants."""
    q1, q3 = quantile_values(df, column, (0.25, 0.75), exact)
    if q1 is None:
        return None, None, None, None
    iqr = q3 - q1
    return q1, q3, q1 - k * iqr, q3 + k * iqr


def outlier_count(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows strictly outside the IQR fences, total rows and their share."""
    q1, q3, lo, hi = iqr_fences(df, column, k)
    x = q(column).cast("double")
    return df.agg(
        F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias("n_outliers"),
        F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.lit(lo).alias("lower"),
        F.lit(hi).alias("upper"), "n_outliers", "n_rows",
        F.try_divide(F.col("n_outliers"), F.col("n_rows")).alias("share"))


def _bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    width = (hi - lo) / bins if hi > lo else 1.0
    raw = F.floor((x - F.lit(lo)) / F.lit(width)).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))


def _min_max(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*[F.min(q(c).cast("double")).alias(f"mn{i}") for i, c in enumerate(cols)],
               *[F.max(q(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"mn{i}"], r[f"mx{i}"]) for i, c in enumerate(cols)}


def hist1d(df: DataFrame, column: str, bins: int = 20,
           bounds: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width histogram (bin, lo, hi, count); the last bin is closed on the right."""
    lo, hi = bounds if bounds else _min_max(df, [column])[column]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    x = q(column).cast("double")
    b = _bin(x, lo, hi, bins)
    return (df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")
            .orderBy("bin"))


def value_grid(df: DataFrame, column: str, points: int, log: bool = False) -> DataFrame:
    """(point, value): evenly spaced points from the smallest to the largest value of a column, or
    log-spaced ones over its positive values (the bounds of a search space taken from data)."""
    x = q(column).cast("double")
    r = df.where(x > 0) if log else df
    b = r.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.col("point") / F.lit(max(points - 1, 1))
    lo, hi = (F.ln("lo"), F.ln("hi")) if log else (F.col("lo"), F.col("hi"))
    value = lo + (hi - lo) * at
    return (b.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .select("point", (F.exp(value) if log else value).alias("value")))


def hist2d(df: DataFrame, x: str, y: str, hue: str | None = None, bins: int = 10) -> DataFrame:
    """Pairwise 2-D histogram (bx, by, hue, count) for one pair of columns."""
    mm = _min_max(df, [x, y])
    (xl, xh), (yl, yh) = mm[x], mm[y]
    keys = [_bin(q(x).cast("double"), xl, xh, bins).alias("bx"),
            _bin(q(y).cast("double"), yl, yh, bins).alias("by")]
    if hue:
        keys.append(q(hue).cast("string").alias("hue"))
    d = df.where(q(x).isNotNull() & q(y).isNotNull())
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def hist2d_pairs(df: DataFrame, columns: Sequence[str], hue: str | None = None,
                 bins: int = 10) -> DataFrame:
    """All pairs (i < j) in long form, from one min/max pass and one grouped count."""
    cols = list(columns)
    mm = _min_max(df, cols)
    binned = df.select(*[_bin(q(c).cast("double"), *mm[c], bins).alias(f"b{i}") for i, c in enumerate(cols)],
                       *([q(hue).cast("string").alias("hue")] if hue else []))
    pairs = [F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"),
                      F.col(f"b{i}").alias("bx"), F.col(f"b{j}").alias("by"))
             for i in range(len(cols)) for j in range(i + 1, len(cols))]
    longf = binned.select(F.explode(F.array(*pairs)).alias("p"), *(["hue"] if hue else []))
    longf = longf.where(F.col("p.bx").isNotNull() & F.col("p.by").isNotNull())
    keys = ["p.x", "p.y", "p.bx", "p.by"] + (["hue"] if hue else [])
    return longf.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))


def scatter(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Every point (x, y, hue): a projection."""
    return df.select(q(x).alias("x"), q(y).alias("y"), *([q(hue).cast("string").alias("hue")] if hue else []))


def scatter_pairs(df: DataFrame, columns: Sequence[str], hue: str | None = None) -> DataFrame:
    """Every point of every pair of columns (i < j) in long form (x_col, y_col, x, y, hue)."""
    cols = list(columns)
    pairs = [F.struct(F.lit(cols[i]).alias("x_col"), F.lit(cols[j]).alias("y_col"),
                      q(cols[i]).cast("double").alias("x"), q(cols[j]).cast("double").alias("y"))
             for i in range(len(cols)) for j in range(i + 1, len(cols))]
    keep = [q(hue).cast("string").alias("hue")] if hue else []
    return df.select(F.explode(F.array(*pairs)).alias("_p"), *keep).select("_p.*", *(["hue"] if hue else []))


def scatter_sample(df: DataFrame, x: str, y: str, hue: str | None = None, n: int = 1000,
                   seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """A sampling operator, for those who ask for it: ``n`` points by md5 order of the row id."""
    order = hash_key(seed, q(id_col))
    return scatter(df.orderBy(order, q(id_col)).limit(n), x, y, hue)


def boxplot(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last points within the fences, outlier count."""
    q1, q3, lo, hi = iqr_fences(df, column, k)
    x = q(column).cast("double")
    inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
    (median,) = quantile_values(df, column, (0.5,))
    return df.agg(
        F.lit(median).cast("double").alias("median"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(x.isNotNull() & ~inside).alias("n_outliers"),
    ).select(F.lit(column).alias("column"), F.lit(q1).alias("q1"), "median", F.lit(q3).alias("q3"),
             F.lit(q3 - q1 if q1 is not None else None).cast("double").alias("iqr"),
             "whisker_low", "whisker_high", "n_outliers")
