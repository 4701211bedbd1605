"""Exact k-nearest neighbours with a tree of pivots (no cross join, no pair rows).

About sqrt(n) reference rows, chosen by a hash of their vectors, are pivots; the first sqrt of them
are the upper level of a tree. A reference row goes to its nearest upper pivot and to the nearest
lower pivot under it: its cell. Of every cell the driver holds the pivot, the number of rows, the radius and
a radius that is known to hold k rows. From these a query gets a bound on its k-th distance before any row
is looked at, and by the triangle inequality it needs only the cells that reach into that bound; whole
upper pivots are ruled out first. Inside a task the rows of a cell are split once more around pivots of
their own, and the bound tightens from one such part to the next, so a query is compared with few rows of a cell.

Of equal vectors only as many as can be asked for stay, so copies cannot fill a cell. Cells are split
into blocks of at most ``block_rows`` rows on either side; a (cell, block) cogroup is one bounded Arrow
batch pair and emits only the ``k`` best per query row. Exact; ties go to the smaller reference id.
In few dimensions most cells are never visited; without structure all are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tricolor.session import cut_lineage, ship_package

# Rows of one side held by one task at a time.
DEFAULT_BLOCK_ROWS = 20_000
# Doubles held by one distance chunk (query rows x reference rows x dimensions).
_CHUNK_CELLS = 8_000_000
# Parts of a cell are not made smaller than this.
_LEAST_PART = 16
# Different values that ``exclude`` may have (folds).
MAX_EXCLUDED = 1000


def _dist(qm: np.ndarray, rm: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Exact distances from direct coordinate differences (no |a|^2 + |b|^2 - 2ab shortcut,
    whose rounding could reorder ties)."""
    diff = np.abs(qm[:, None, :] - rm[None, :, :])
    if metric == "euclidean" or (metric == "minkowski" and p == 2):
        return np.sqrt((diff * diff).sum(2))
    if metric == "manhattan" or (metric == "minkowski" and p == 1):
        return diff.sum(2)
    if metric == "minkowski" and p > 1:
        return (diff ** p).sum(2) ** (1.0 / p)
    raise ValueError(f"no metric {metric!r} with p = {p}")


def _distances(qm: np.ndarray, rm: np.ndarray, metric: str, p: float) -> np.ndarray:
    """``_dist`` in slices of bounded size."""
    step = max(1, _CHUNK_CELLS // max(1, rm.size))
    parts = [_dist(qm[s:s + step], rm, metric, p) for s in range(0, len(qm), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(rm)))


def _reaches(d: np.ndarray, radius: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Whether a ball at distance ``d`` can hold a row within ``tau``; rounding and overflow count as yes."""
    with np.errstate(invalid="ignore"):
        return ~(d - radius > tau + 1e-9 * (d + radius + tau))


class PivotTree:
    """Two levels of pivots; after ``measure`` it also knows what the cells hold."""

    def __init__(self, pivots: np.ndarray, metric: str, p: float):
        self.leaves, self.metric, self.p = pivots, metric, p
        self.tops = pivots[: max(1, int(np.ceil(np.sqrt(len(pivots)))))]
        over = self._d(pivots, self.tops)
        top = over.argmin(1)
        top[: len(self.tops)] = np.arange(len(self.tops))   # also where a distance underflows to 0
        self.gap = over[np.arange(len(pivots)), top]
        self.under = [np.flatnonzero(top == t) for t in range(len(self.tops))]

    def _d(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _distances(a, b, self.metric, self.p)

    def assign(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of every row and its distance from the cell's pivot."""
        top = self._d(vecs, self.tops).argmin(1)
        cell, far = np.zeros(len(vecs), np.int64), np.zeros(len(vecs))
        for t in np.unique(top):
            i = np.flatnonzero(top == t)
            d = self._d(vecs[i], self.leaves[self.under[t]])
            cell[i], far[i] = self.under[t][d.argmin(1)], d.min(1)
        return cell, far

    def measure(self, count: np.ndarray, near: np.ndarray, radius: np.ndarray) -> None:
        """``count`` and ``near`` (cells x excluded values): rows and a radius that holds enough of them."""
        self.count, self.near, self.radius = count, near, radius
        self.top_count = np.array([count[u].sum(0) for u in self.under])
        self.top_radius = np.array([np.max(np.where(count[u, 0] > 0, self.gap[u] + radius[u], 0), initial=0) for u in self.under])

    def visits(self, vecs: np.ndarray, out: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, bound) of every cell that may hold one of the ``need`` nearest rows of a query."""
        d = self._d(vecs, self.tops)
        tau = np.full(len(vecs), np.inf)
        if len(vecs) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), tau
        reach = d + self.top_radius[None, :]
        order = np.argsort(reach, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(self.top_count[:, out].T, order, axis=1), axis=1)
        enough = held >= need
        found = enough.any(1)
        at = order[np.arange(len(vecs)), enough.argmax(1)]
        tau[found] = reach[np.flatnonzero(found), at[found]]
        nearest = d.argmin(1)

        def leaves(t: int, i: np.ndarray):
            u = self.under[t]
            dl = self._d(vecs[i], self.leaves[u])
            tau[i] = np.minimum(tau[i], (dl + self.near[u][:, out[i]].T).min(1, initial=np.inf))
            return dl

        kept = []
        for t in np.unique(nearest):
            i = np.flatnonzero(nearest == t)
            kept.append((t, i, leaves(t, i)))
        for t in range(len(self.tops)):
            i = np.flatnonzero((nearest != t) & _reaches(d[:, t], self.top_radius[t], tau) & (self.top_count[t, 0] > 0))
            if len(i):
                kept.append((t, i, leaves(t, i)))
        qs, cells = [], []
        for t, i, dl in kept:   # the bound is now as tight as it gets
            u = self.under[t]
            a, b = np.nonzero(_reaches(dl, self.radius[u][None, :], tau[i][:, None]) & (self.count[u][:, out[i]].T > 0))
            qs.append(i[a])
            cells.append(u[b])
        return np.concatenate(qs), np.concatenate(cells), tau


def nearest_in_block(qids, qm, qout, tau, rids, rm, rout, k: int, metric: str, p: float, exclude_self: bool):
    """Distances and positions (queries x k; inf where there are fewer) of the nearest rows of one block.

    ``rids`` ascend. The rows are split around every sqrt-th of them; a query sees the part of its nearest
    pivot first, then those parts that its bound (at most ``tau``) still reaches."""
    n = len(rids)
    parts = max(1, min(int(np.sqrt(n)), n // _LEAST_PART))
    pivots = rm[np.linspace(0, n - 1, parts).astype(np.int64)] if parts > 1 else rm[:1]
    if parts > 1:
        away = _distances(rm, pivots, metric, p)
        part, far = away.argmin(1), away.min(1)
        dq = _distances(qm, pivots, metric, p)
        home = dq.argmin(1)
    else:
        part, far, home = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(len(qids), np.int64)
        dq = np.zeros((len(qids), 1))
    best_d, best_i = np.full((len(qids), k), np.inf), np.full((len(qids), k), n, np.int64)
    tau = tau.copy()

    def look(rows: np.ndarray, asked: np.ndarray) -> None:
        step = max(1, _CHUNK_CELLS // max(1, len(rows) * rm.shape[1]))
        for s in range(0, len(asked), step):
            qi = asked[s:s + step]
            d = _dist(qm[qi], rm[rows], metric, p)
            if exclude_self:
                d[qids[qi][:, None] == rids[rows][None, :]] = np.inf
            if rout is not None:
                d[qout[qi][:, None] == rout[rows][None, :]] = np.inf
            # a stable order keeps the smaller id first among ties
            idx = np.argsort(d, axis=1, kind="stable")[:, :k]
            both_d = np.concatenate([best_d[qi], np.take_along_axis(d, idx, axis=1)], axis=1)
            both_i = np.concatenate([best_i[qi], rows[idx]], axis=1)
            both_i[~np.isfinite(both_d)] = n
            order = np.lexsort((both_i, both_d), axis=1)[:, :k]
            best_d[qi] = np.take_along_axis(both_d, order, axis=1)
            best_i[qi] = np.take_along_axis(both_i, order, axis=1)
            tau[qi] = np.minimum(tau[qi], best_d[qi, k - 1])

    members = [np.flatnonzero(part == s) for s in range(parts)]
    for s, rows in enumerate(members):
        asked = np.flatnonzero(home == s)
        if len(rows) and len(asked):
            look(rows, asked)
    for s, rows in enumerate(members):
        if len(rows):
            asked = np.flatnonzero((home != s) & _reaches(dq[:, s], far[rows].max(), tau))
            if len(asked):
                look(rows, asked)
    return best_d, best_i


def _topk_fn(k: int, metric: str, p: float, exclude_self: bool, excluding: bool, payload: tuple, fields: tuple):
    def fn(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or rpdf.empty:
            return pd.DataFrame({name: pd.Series([], dtype="object") for name in fields})
        rpdf = rpdf.sort_values("rid", kind="stable")
        rids = rpdf["rid"].to_numpy(dtype=np.int64)
        rm = np.stack(rpdf["rvec"].to_numpy()).astype(np.float64)
        qids = qpdf["qid"].to_numpy(dtype=np.int64)
        qm = np.stack(qpdf["qvec"].to_numpy()).astype(np.float64)
        kk = min(k, len(rids))
        d, i = nearest_in_block(qids, qm, qpdf["out"].to_numpy(), qpdf["tau"].to_numpy(dtype=np.float64), rids, rm,
                                rpdf["out"].to_numpy() if excluding else None, kk, metric, p, exclude_self)
        keep = np.isfinite(d)
        out = {"qid": np.repeat(qids, kk).reshape(len(qids), kk)[keep], "rid": rids[i[keep]], "dist": d[keep]}
        for name in payload:
            out[name] = pd.Series(list(rpdf[name].to_numpy()[i[keep]]), dtype=object)
        return pd.DataFrame(out)
    return fn


def _spread(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A block in [0, parts) for every id, whatever steps the ids come in."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def _cell_stats(celled: DataFrame, outs: list, need: int) -> DataFrame:
    """(cell, out, n, near, far): rows of a cell without those of one excluded value, a radius that holds
    ``need`` of them (null if there are fewer), and the radius of the cell.

    Rows are counted by quarter octaves of their distance from the pivot, so the aggregate is partial
    and ``near`` is the largest distance of the octave in which ``need`` is reached."""
    level = F.coalesce(F.ceil(F.log2("far") * 4), F.lit(-100000)).cast("bigint")
    levels = celled.groupBy("cell", "out", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"))
    without = F.explode(F.array(*[F.lit(i) for i in range(len(outs))]))
    levels = (levels.withColumn("wo", without).where((F.col("wo") == 0) | (F.col("wo") != F.col("out")))
              .groupBy("cell", "wo", "level").agg(F.sum("n").alias("n"), F.max("far").alias("far")))
    upto = Window.partitionBy("cell", "wo").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("held", F.sum("n").over(upto)).withColumn("reach", F.max("far").over(upto))
    return levels.groupBy("cell", "wo").agg(F.sum("n").alias("n"), F.min(F.when(F.col("held") >= need, F.col("reach"))).alias("near"),
                                            F.max("far").alias("far"))


def knn(query: DataFrame, ref: DataFrame, k: int, qid: str = "row_id", qvec: str = "features",
        rid: str = "row_id", rvec: str = "features", metric: str = "euclidean", p: float = 2.0,
        exclude_self: bool = False, block_rows: int = DEFAULT_BLOCK_ROWS,
        payload: dict[str, str] | None = None, exclude: str | None = None) -> DataFrame:
    """(qid, rid, dist, nn_rank, *payload) for the ``k`` nearest reference rows of every query row.

    ``payload`` maps reference columns to their types; they ride along with each neighbour so
    callers need no join back to the reference rows (a hub row would skew that join). Rows with a
    missing or non-finite coordinate have no neighbours and are nobody's. ``exclude`` names an integer column of
    both frames (a fold): reference rows of the query's own value are not its neighbours.
    """
    payload = dict(payload or {})
    spark = query.sparkSession
    ship_package(spark)
    finite = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fold = F.coalesce(F.col(exclude).cast("bigint"), F.lit(-1)).alias("value") if exclude else F.lit(-1).cast("bigint").alias("value")
    need = k + (1 if exclude_self else 0)
    # of equal vectors only those with the smallest ids can be among the nearest
    same = Window.partitionBy("rvec", "value").orderBy("rid")
    rs = (ref.select(F.col(rid).cast("bigint").alias("rid"), F.col(rvec).cast("array<double>").alias("rvec"), fold,
                     *[F.col(c).cast(t).alias(c) for c, t in payload.items()]).where(finite("rvec"))
          .withColumn("_same", F.row_number().over(same)).where(F.col("_same") <= need).drop("_same"))
    rs = cut_lineage(rs)
    qs = query.select(F.col(qid).cast("bigint").alias("qid"), F.col(qvec).cast("array<double>").alias("qvec"), fold).where(finite("qvec"))
    qs = cut_lineage(qs)   # read by the count of visits and by the search
    types = {"qid": "bigint", "rid": "bigint", "dist": "double", **payload}
    key = F.xxhash64("rvec")
    distinct = rs.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    if not distinct:
        return spark.createDataFrame([], ", ".join([*[f"`{c}` {t}" for c, t in types.items()], "nn_rank int"]))
    # sqrt(n) expected pivots; the driver holds them and three numbers for each
    share = min(1.0, distinct ** -0.5)
    chosen = rs.where(F.pmod(key, F.lit(1 << 40)) <= int(share * (1 << 40))).select("rvec").distinct().collect()
    pivots = np.unique(np.array([r["rvec"] for r in chosen] or [rs.select("rvec").first()["rvec"]], float), axis=0)
    pivots = pivots[np.random.default_rng(42).permutation(len(pivots))]   # the tops are any of them
    tree = PivotTree(pivots, metric, p)
    outs: list = [None]
    if exclude:
        found = rs.select("value").distinct().limit(MAX_EXCLUDED + 1).collect()
        if len(found) > MAX_EXCLUDED:
            raise ValueError(f"{exclude} has more than {MAX_EXCLUDED} values")
        outs += sorted(r["value"] for r in found)
    code = {v: i for i, v in enumerate(outs)}
    row_fields = {"rid": "bigint", "rvec": "array<double>", **payload}

    def cells(blocks: np.ndarray | None, copies: np.ndarray | None):
        """Rows with their cell, block and, once the queries are counted, a copy for each query block."""
        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                cell, far = tree.assign(np.stack(b["rvec"].to_numpy()))
                out = b["value"].map(code).to_numpy(np.int64) if exclude else np.full(len(b), -1, np.int64)
                if blocks is None:
                    yield pd.DataFrame({"cell": cell, "out": out, "far": far})
                    continue
                times = copies[cell]
                i = np.repeat(np.arange(len(b)), times)
                got = b[list(row_fields)].iloc[i].reset_index(drop=True)
                got["cell"], got["out"] = cell[i], out[i]
                got["rb"] = _spread(b["rid"].to_numpy(np.int64), blocks[cell])[i]
                got["qb"] = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                yield got
        return run

    stats = _cell_stats(rs.mapInPandas(cells(None, None), "cell bigint, out bigint, far double"), outs, need).collect()
    count = np.zeros((len(pivots), len(outs)), np.int64)
    near, radius = np.full(count.shape, np.inf), np.zeros(len(pivots))
    for r in stats:
        count[r["cell"], r["wo"]] = r["n"]
        near[r["cell"], r["wo"]] = np.inf if r["near"] is None else r["near"]
        radius[r["cell"]] = max(radius[r["cell"]], r["far"])
    tree.measure(count, near, radius)
    blocks = np.maximum(1, -(-count[:, 0] // block_rows))
    step = max(1, 2_000_000 // len(pivots))   # queries looked at together

    def asks(copies: np.ndarray | None):
        """Queries with every cell and block they visit, or only how many visit each cell."""
        def run(batches):
            for b in batches:
                out_all = b["value"].map(code).fillna(0).to_numpy(np.int64) if exclude else np.zeros(len(b), np.int64)
                for s in range(0, len(b), step):
                    part, out = b.iloc[s:s + step], out_all[s:s + step]
                    i, cell, tau = tree.visits(np.stack(part["qvec"].to_numpy()), out, need)
                    if copies is None:
                        c, n = np.unique(cell, return_counts=True)
                        yield pd.DataFrame({"cell": c, "n": n})
                        continue
                    times = blocks[cell]
                    j = np.repeat(np.arange(len(i)), times)
                    ids = part["qid"].to_numpy(np.int64)[i[j]]
                    yield pd.DataFrame({
                        "qid": ids, "qvec": list(part["qvec"].to_numpy()[i[j]]), "cell": cell[j], "out": out[i[j]], "tau": tau[i[j]],
                        "qb": _spread(ids, copies[cell[j]]), "rb": np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times)})
        return run

    asked_n = np.zeros(len(pivots), np.int64)
    for r in qs.mapInPandas(asks(None), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        asked_n[r["cell"]] = r["n"]
    copies = np.maximum(1, -(-asked_n // block_rows))
    copies[asked_n == 0] = 0   # rows of a cell that nobody visits stay at home
    asked = qs.mapInPandas(asks(np.maximum(copies, 1)), "qid bigint, qvec array<double>, cell bigint, out bigint, tau double, qb bigint, rb bigint")
    held = rs.mapInPandas(cells(blocks, copies), ", ".join([*[f"`{c}` {t}" for c, t in row_fields.items()],
                                                           "cell bigint", "out bigint", "rb bigint", "qb bigint"]))
    match = _topk_fn(k, metric, p, exclude_self, exclude is not None, tuple(payload), tuple(types))
    near_rows = (asked.groupBy("cell", "qb", "rb").cogroup(held.groupBy("cell", "qb", "rb"))
                 .applyInPandas(match, ", ".join(f"`{c}` {t}" for c, t in types.items())))
    best = Window.partitionBy("qid").orderBy("dist", "rid")
    return near_rows.withColumn("nn_rank", F.row_number().over(best)).where(F.col("nn_rank") <= k)
