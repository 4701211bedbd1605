"""Centroid clustering by Lloyd's rounds, exact in integers, with geometric drift tightening.

Every vector carries its cluster, the exact squared distance to that centroid and a lower bound of
its distance to all other centroids. When centroids have moved, the bound does not fall by the
largest drift. All members of a cluster lie in the sphere about its former centroid that reaches
its furthest member; seen from a moved centroid's former place, that sphere fills a cone about the
line to its centre. In the plane of that line and of the move, no member comes nearer than drift x
cosine of the angle between the move and the nearest side of the cone (``loosening``), which is
below zero where the centroid moves away.

A vector whose distance to its own (moved) centroid is below that bound, or below half the way to
the nearest other centroid, keeps its cluster; the others are compared with all centroids. Both
tests are strict and leave a margin for rounding, so that ties always reach the exact comparison.

A round is one pass over the written state of the former round and one aggregate of cluster sums
(added up per task); the driver holds k centroids. State is written as Parquet to the shared
folder, so a lost executor re-reads one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.llm.common import stage_table
from tricolor.session import ship_package

EPS = 1e-12      # rounding of a square root and a product, generously
SLACK = 1e-7     # rounding of a sine that is computed from a cosine
LARGEST = 2.0 ** 55
STATE = "id long, v array<long>, cluster int, distance long, upper double, lower double, scanned boolean"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): vectors of exactly ``dims`` finite components, each as floor(scale * x)."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)
    x = F.col(vec_col).cast("array<double>")
    return (df.where((F.size(vec_col) == dims) & F.forall(x, ok))
            .select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda y: F.floor(y * scale).cast("bigint")).alias("v")))


def _kind(dims: int, *arrays: np.ndarray):
    """The cheapest number type in which squared distances of these vectors are exact."""
    most = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    worst = dims * (2 * most) ** 2
    return np.float64 if worst < 1 << 52 else np.int64 if worst < 1 << 63 else object


def square_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``v`` to all rows of ``c``."""
    kind = _kind(v.shape[1], v, c)
    if kind is np.float64:  # every sum below is under 2**52, so that the products by BLAS are exact
        a, b = v.astype(kind), c.astype(kind)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, b = v.astype(kind), c.astype(kind)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


def _own_distances(v: np.ndarray, c: np.ndarray, a: np.ndarray) -> np.ndarray:
    kind = _kind(v.shape[1], v, c)
    kind = np.int64 if kind is np.float64 else kind
    gap = v.astype(kind) - c.astype(kind)[a]
    return (gap * gap).sum(1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the distance from a member to any other centroid can have fallen.

    ``radius[i]`` reaches from ``old[i]`` to the furthest member of cluster i. At most the largest
    drift of the other centroids, less where the sphere lies aside of or behind a move."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    out = np.full(len(old), -np.inf)
    for i in range(len(old)):
        for j in range(len(old)):
            if i == j:
                continue
            move, way = new[j] - old[j], old[i] - old[j]
            drift, far = float(np.linalg.norm(move)), float(np.linalg.norm(way))
            fall = drift
            if drift and far > radius[i]:
                cos_way = float(np.clip(way @ move / (far * drift), -1, 1))
                sin_cone = radius[i] / far
                cos_cone = float(np.sqrt(1 - sin_cone * sin_cone))
                if cos_way < cos_cone:  # the move does not point into the cone
                    side = cos_way * cos_cone + float(np.sqrt(1 - cos_way * cos_way)) * sin_cone
                    fall = drift * min(1.0, side + SLACK)
            out[i] = max(out[i], fall + EPS * (drift + far))
    return out


def _apart(c: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to its nearest other one."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    d = np.sqrt(square_distances(c, c).astype(np.float64))
    np.fill_diagonal(d, np.inf)
    return d.min(1) / 2 * (1 - EPS)


def _assign(centroids: np.ndarray, loosen: np.ndarray | None):
    """The kernel of a round: rows of the state (or bare vectors, ``loosen`` None) -> rows of the state."""
    apart = _apart(centroids)
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column("v").flatten().to_numpy().reshape(n, dims)
            if loosen is None:
                cluster, lower, scan = np.zeros(n, np.int32), np.zeros(n), np.ones(n, bool)
                own = np.zeros(n, np.int64)
            else:
                cluster = b.column("cluster").to_numpy().copy()
                lower = b.column("lower").to_numpy() - loosen[cluster]
                own = _own_distances(v, centroids, cluster)
                scan = ~(np.sqrt(own.astype(np.float64)) * (1 + EPS) < np.maximum(lower, apart[cluster]))
            at = np.flatnonzero(scan)
            if len(at):
                d = square_distances(v[at], centroids)
                best = d.argmin(1).astype(np.int32)  # the first of equal ones is the smaller number
                cluster[at] = best
                nearest = d[np.arange(len(at)), best]
                own = own.astype(object) if nearest.dtype == object else own
                own[at] = nearest
                d[np.arange(len(at)), best] = d.max() + 1 if d.dtype == object else np.iinfo(np.int64).max
                lower[at] = np.sqrt(d.min(1).astype(np.float64)) * (1 - EPS) if len(centroids) > 1 else np.inf
            whole = own if own.dtype != object else [int(x) if x < 1 << 63 else None for x in own]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(whole, pa.int64()),
                 pa.array(np.sqrt(own.astype(np.float64)) * (1 + EPS)), pa.array(lower), pa.array(scan)],
                names=["id", "v", "cluster", "distance", "upper", "lower", "scanned"])
    return run


def _sums(k: int, dims: int):
    """Per task and cluster: component sums (exact), members and the furthest member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, reach = np.zeros((k, dims), object), np.zeros(k, np.int64), np.zeros(k)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v, cluster = b.column("v").flatten().to_numpy().reshape(n, dims), b.column("cluster").to_numpy()
            v = v if int(abs(v).max()) * n < 1 << 63 else v.astype(object)
            upper = b.column("upper").to_numpy()
            for c in np.unique(cluster):
                mine = cluster == c
                total[c] += v[mine].sum(0).astype(object)
                count[c] += int(mine.sum())
                reach[c] = max(reach[c], float(upper[mine].max()))
        held = np.flatnonzero(count)
        rows = [(int(c), d, Decimal(int(total[c][d])), int(count[c]), float(reach[c])) for c in held for d in range(dims)]
        cols = list(zip(*rows)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["cluster", "dim", "total", "n", "reach"])
    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, radius of every cluster about its former centroid): k x dims rows reach the driver."""
    k, dims = centroids.shape
    rows = (state.select("v", "cluster", "upper").mapInArrow(_sums(k, dims), "cluster int, dim int, total decimal(38,0), n long, reach double")
            .groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("reach").alias("reach")).collect())
    new, radius = centroids.copy(), np.zeros(k)
    for r in rows:
        new[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        radius[r["cluster"]] = r["reach"]
    return new, radius


def drift_clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 16,
                   rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """One row per vector: (id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned).

    Centroids start as the ``k`` vectors whose sha256 of ``<seed>:<id>`` is smallest; ``rounds`` times
    vectors go to the nearest centroid (ties: smaller number) and centroids to the floor of their
    members' mean, then vectors are assigned once more. ``scanned``: the last assignment compared
    the vector with all centroids.

    Edge cases: vectors that are null, of another length, or with null or non-finite components (or
    components of 2**55 and more, whose integers no long holds) have no row; a null id takes part,
    and comes last in the choice of the first centroids; rows that share an id are vectors of their
    own, and of those the smaller vector starts first; fewer than ``k`` vectors give as many
    centroids; a cluster without members keeps its centroid; an empty table gives an empty result;
    a distance or inertia that no long holds is null. Other columns are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    vectors = integer_vectors(df, id_col, vec_col, dims, scale)
    first = (vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
             .orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect())
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        return vectors.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
            ("centroid_sha256", "string"), ("scanned", "boolean"))])
    state = stage_table(vectors.mapInArrow(_assign(centroids, None), STATE), "clusters")
    for _ in range(rounds):
        new, radius = _moved(state, centroids)
        state = stage_table(state.mapInArrow(_assign(new, loosening(centroids, new, radius)), STATE), "clusters")
        centroids = new
    per = (state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
                                        F.count_if(F.col("distance").isNull()).alias("beyond")).collect())
    fits = lambda x, beyond: int(x) if not beyond and x < 1 << 63 else None
    everything = fits(sum(r["s"] or 0 for r in per), sum(r["beyond"] for r in per))
    digest = [(r["cluster"], fits(r["s"] or 0, r["beyond"]), everything,
               sha256(",".join(str(int(x)) for x in centroids[r["cluster"]]).encode()).hexdigest()) for r in per]
    # one row per cluster
    sums = spark.createDataFrame(digest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (state.join(F.broadcast(sums), "cluster")
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned"))
