"""Cross products of many columns: a blocked Gram aggregate with pairwise-complete NULLs.

Columns travel as one vector. A task adds up, for its rows, the products of all pairs of column blocks
(matrix products of values about the column means, and of their NULL masks), and emits one row per pair
of blocks; these partial sums are exchanged by block pair and added up as they stream in, so no plan has
an expression per pair of columns and no task more than ``columns``² sums. Centring first keeps the
sums free of cancellation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.operators.profile import q
from tricolor.session import ship_package

BLOCK = 64
# Sums of a pair (i, j) over the rows where both are present: rows, x, y, x y, x x, y y, and rows with NaN or infinity.
_SUMS = 7


def _products(x: np.ndarray, here: np.ndarray, a: slice, b: slice) -> np.ndarray:
    odd = here & ~np.isfinite(x)
    z = np.where(here & ~odd, x, 0.0)
    m, o = here.astype(float), odd.astype(float)
    return np.stack([m[:, a].T @ m[:, b], z[:, a].T @ m[:, b], m[:, a].T @ z[:, b], z[:, a].T @ z[:, b],
                     (z[:, a] ** 2).T @ m[:, b], m[:, a].T @ z[:, b] ** 2, o[:, a].T @ m[:, b] + m[:, a].T @ o[:, b]])


def pair_sums(df: DataFrame, columns: Sequence[str], finish: Callable, schema: str, group: str | None = None) -> DataFrame:
    """``finish(group, first column of either block, sums)`` gives the record batch of a pair of blocks i <= j.

    ``sums`` is (7, rows of block i, columns of block j), about the means of the columns over all of ``df``.
    ``group`` is an integer column with few values (folds); without it the group is 0."""
    ship_package(df.sparkSession)
    p = len(columns)
    x = [q(c).cast("double") for c in columns]
    usable = [F.when(F.abs(e) < float("inf"), e) for e in x]   # not null, NaN or infinite
    centre = np.array([0.0 if v is None else v for v in df.agg(F.array(*[F.avg(e) for e in usable]).alias("m")).first()["m"]])
    cuts = [slice(s, min(s + BLOCK, p)) for s in range(0, p, BLOCK)]
    pairs = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("x").flatten()
            here = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, p)
            with np.errstate(invalid="ignore"):
                v = flat.fill_null(0.0).to_numpy().reshape(-1, p) - centre
            g = b.column("g").to_numpy()
            for key in np.unique(g):
                mine = g == key
                for i, j in pairs:
                    s = _products(v[mine], here[mine], cuts[i], cuts[j])
                    at = (int(key), i, j)
                    total[at] = s if at not in total else total[at] + s
        yield _rows(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                at, s = (r["g"], r["i"], r["j"]), np.frombuffer(r["s"])
                total[at] = total[at] + s if len(s) and len(total.get(at, b"")) else s if len(s) else total.get(at, s)
        for (g, i, j), s in total.items():
            shape = (_SUMS, cuts[i].stop - cuts[i].start, cuts[j].stop - cuts[j].start)
            yield finish(g, cuts[i].start, cuts[j].start, s.reshape(shape) if len(s) else np.zeros(shape))

    keyed = df.select((F.lit(0) if group is None else q(group)).cast("bigint").alias("g"), F.array(*x).alias("x"))
    parts = keyed.mapInArrow(add, "g long, i long, j long, s binary")
    if group is None:   # every pair is there, also without a row
        none = df.sparkSession.createDataFrame([(0, i, j, b"") for i, j in pairs], parts.schema)
        parts = parts.unionByName(none)
    return parts.repartition("g", "i", "j").mapInArrow(merge, schema)


def _rows(total: dict) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_arrays([*[pa.array([k[n] for k in keys], pa.int64()) for n in range(3)],
                                       pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["g", "i", "j", "s"])


def moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, products, squares of x, squares of y) of every pair, all about the pair's own means."""
    n, sx, sy, sxy, sxx, syy, odd = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        xy, xx, yy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    bad = odd > 0
    return n, np.where(bad, np.nan, xy), np.where(bad, np.nan, xx), np.where(bad, np.nan, yy)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) of all ordered pairs; NULLs are skipped pairwise.

    ``corr`` is NULL without two common rows or with a constant column, NaN where a common row has NaN or infinity."""
    names = np.array(list(columns), object)

    def finish(_g: int, a: int, b: int, sums: np.ndarray) -> pa.RecordBatch:
        n, xy, xx, yy = moments(sums)
        with np.errstate(invalid="ignore", divide="ignore"):
            # rounding can leave a constant column a tiny rest, or pass 1
            flat = (xx <= 1e-14 * sums[4]) | (yy <= 1e-14 * sums[5])
            corr = np.clip(xy / np.sqrt(xx) / np.sqrt(yy), -1.0, 1.0)
        none = (n < 2) | flat
        i, j = np.indices(corr.shape)
        i, j = (i + a).ravel(), (j + b).ravel()
        once = i <= j
        i, j, corr, none = i[once], j[once], corr.ravel()[once], none.ravel()[once]
        twice = i < j
        first, second = np.concatenate([i, j[twice]]), np.concatenate([j, i[twice]])
        value = pa.array(np.concatenate([corr, corr[twice]]), mask=np.concatenate([none, none[twice]]), from_pandas=False)
        return pa.RecordBatch.from_arrays([pa.array(names[first], pa.string()), pa.array(names[second], pa.string()), value],
                                          names=["col_a", "col_b", "corr"])
    return pair_sums(df, columns, finish, "col_a string, col_b string, corr double")


def group_products(df: DataFrame, columns: Sequence[str], group: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """group -> (rows, means, products about the means) over rows without NULLs; columns² numbers per group reach the driver."""
    p = len(columns)
    whole = df.where(F.forall(F.array(*[q(c).cast("double") for c in columns]), lambda v: v.isNotNull()))
    centre_at = whole.groupBy(q(group).cast("bigint").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(q(c).cast("double")) for c in columns]).alias("m")).collect()

    def finish(g: int, a: int, b: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"g": [g], "a": [a], "b": [b], "s": [moments(sums)[1].tobytes()]})

    out = {r["g"]: (r["n"], np.array(r["m"], float), np.zeros((p, p))) for r in centre_at}
    for r in pair_sums(whole, columns, finish, "g long, a long, b long, s binary", group).collect():
        a, b = r["a"], r["b"]
        s = np.frombuffer(r["s"]).reshape(min(BLOCK, p - a), -1)
        about = out[r["g"]][2]
        about[a:a + s.shape[0], b:b + s.shape[1]] = s
        about[b:b + s.shape[1], a:a + s.shape[0]] = s.T
    return out
