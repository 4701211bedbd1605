"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

A tree is a sorted array of hash strings of 64 bits (signs of random projections) with the rows they
belong to. A query descends every tree to its longest matching prefix, and the trees ascend together
until the rows under the prefixes, counted once per tree, are enough: ``probe`` of the block, by one rule for
blocks of every size. The rows under a prefix only grow on the way up, so the level is found by bisection; those rows are
scored exactly in double precision.

Inner products become angles by one extra coordinate that lifts every row to the largest norm of its
block; queries have 0 there, so that the angle falls with the inner product alone. Rows are dealt
into blocks of about ``block`` rows, first by norm (halvings of the largest), since a few long
vectors would otherwise leave the short ones alike, then by a hash of the id, and a block's forest is one
row of the index table, written once. Queries are a stated set, dealt into chunks that are coded once; a
block stays in its task while all chunks stream past it, and the per-block best are merged per query. Equal vectors form
a group of which only the k + 1 smallest ids can ever be answers, so only those are indexed; a
third of all rows may be copies of one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tricolor.llm.common import runs, ship, stage_table

BITS = 64
BANDS = 32
_SCHEMA = "block long, chunk long, ids binary, vecs binary, codes binary, rows binary"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, log2 of the norm) of the vectors that take part: not null, not zero, all components finite,
    and of the table's most frequent dimension; rows with a null id are left out."""
    v = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    v = v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # the largest component is taken out, so that squares neither vanish nor overflow
    most = F.array_max(F.transform("vec", F.abs))
    v = v.withColumn("most", most).where("most > 0")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    v = v.select("id", "vec", (F.log2("most") + F.log2(square) / 2).alias("norm"))
    dim = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("vec") == (dim["d"] if dim else 0))


def _scaled(x: np.ndarray, each: bool) -> np.ndarray:
    """Vectors without their largest component: each without its own, or all without the block's."""
    most = np.abs(x).max(axis=1, initial=0.0, keepdims=True) if each else np.abs(x).max(initial=0.0)
    return x / most


def _codes(x: np.ndarray, trees: int, lifted: bool) -> np.ndarray:
    """Hash strings (rows, trees) of vectors, rows being ``lifted`` to the largest norm among them."""
    x = _scaled(x, not lifted)
    square = (x * x).sum(axis=1)
    lift = np.sqrt(square.max(initial=0.0) - square) if lifted else np.zeros(len(x))
    planes = np.random.default_rng(4099).standard_normal((x.shape[1] + 1, trees * BITS), np.float32)
    y = np.concatenate([x, lift[:, None]], axis=1).astype(np.float32)
    out = np.empty((len(x), trees), np.uint64)
    for at in range(0, len(x), 1024):
        bits = (y[at:at + 1024] @ planes > 0).reshape(-1, trees, BITS)
        out[at:at + 1024] = np.packbits(bits, axis=2).view(">u8")[:, :, 0]
    return out


def _vectors(t: pa.Table) -> np.ndarray:
    c = t.column("vec").combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy().reshape(len(c), -1)


def _gather(key: str, build):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, [key]):
            for lo, hi in zip(cut[:-1], cut[1:]):
                g = t.slice(lo, hi - lo)
                yield build(g.column(key)[0].as_py(), g.column("id").to_numpy(), _vectors(g))
    return run


def build_forest(vectors: DataFrame, copies: int, trees: int, block: int) -> tuple[DataFrame, int]:
    """The index table (block, chunk -1, ids, vecs, codes, rows) and its number of blocks."""
    top = float(vectors.agg(F.max("norm")).first()[0] or 0.0)
    band = F.floor(F.least(F.lit(top) - F.col("norm"), F.lit(BANDS - 1.0))).cast("int")
    sizes = dict(vectors.groupBy(band).count().collect())  # at most BANDS rows
    parts = [-(-sizes.get(i, 0) // block) for i in range(BANDS)]
    blocks = max(1, sum(parts))
    at = lambda x: F.element_at(F.array(*map(F.lit, x)), band + 1).cast("bigint")
    dealt = at([sum(parts[:i]) for i in range(BANDS)]) + F.pmod(F.xxhash64("id"), at(parts))

    def one(b: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        codes = _codes(x, trees, True).T
        order = np.argsort(codes, axis=1, kind="stable")
        return pa.RecordBatch.from_pydict({
            "block": [b], "chunk": [-1], "ids": [ids.tobytes()], "vecs": [x.tobytes()],
            "codes": [np.take_along_axis(codes, order, axis=1).tobytes()], "rows": [order.astype(np.int32).tobytes()]})

    first = vectors.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= copies)
    index = (first.withColumn("block", dealt).select("block", "id", "vec")
             .repartition("block").sortWithinPartitions("block", "id")
             .mapInArrow(_gather("block", one), _SCHEMA))
    return stage_table(index, "forest"), blocks


def _under(codes: np.ndarray, qcodes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs [lo, hi) (trees, queries) of a block's sorted codes that share ``depth`` first bits with the queries."""
    free = np.where(depth > 0, ~np.uint64(0) >> np.minimum(depth, 63).astype(np.uint64), ~np.uint64(0))
    free[depth == BITS] = 0
    lo = np.empty((codes.shape[0], len(depth)), np.int32)
    hi = np.empty_like(lo)
    for t, column in enumerate(codes):
        lo[t] = np.searchsorted(column, qcodes[:, t] & ~free, "left")
        hi[t] = np.searchsorted(column, qcodes[:, t] | free, "right")
    return lo, hi


def _search_block(ids, vecs, codes, rows, qids, queries, qcodes, k: int, probe: float):
    n, trees = len(ids), codes.shape[0]
    need = min(int(np.ceil(probe * n)), n * trees)
    # the longest common prefix length with which enough rows are below
    depth, above = np.zeros(len(qids), np.int64), np.full(len(qids), BITS + 1, np.int64)
    while (above - depth > 1).any():
        mid = np.minimum((depth + above) // 2, BITS)
        lo, hi = _under(codes, qcodes, mid)
        enough = (hi - lo).sum(axis=0) >= need
        depth, above = np.where(enough, mid, depth), np.where(enough, above, mid)
    lo, hi = _under(codes, qcodes, depth)
    for q in range(len(qids)):
        seen, p, run = np.zeros(n, bool), depth[q], (lo[:, q], hi[:, q])
        while True:
            for t in range(trees):
                seen[rows[t, run[0][t]:run[1][t]]] = True
            seen[ids == qids[q]] = False
            at = np.flatnonzero(seen)
            if len(at) >= k or p == 0:
                break
            p -= 1   # the trees agree on fewer than k rows
            run = tuple(x[:, 0] for x in _under(codes, qcodes[q:q + 1], np.array([p])))
        score = (vecs[at] * queries[q]).sum(axis=1)
        score[np.isnan(score)] = -np.inf
        if len(at) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= edge], score[score >= edge]
        best = np.lexsort((ids[at], -score))[:k]
        yield np.full(len(best), qids[q]), ids[at[best]], score[best]


def _search(trees: int, k: int, probe: float):
    """Partitions hold a block, then the chunks of queries that are asked of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                vecs = np.frombuffer(r["vecs"], float).reshape(len(ids), -1)
                codes = np.frombuffer(r["codes"], np.uint64)
                if r["chunk"] < 0:
                    held = (ids, vecs, codes.reshape(trees, -1), np.frombuffer(r["rows"], np.int32).reshape(trees, -1))
                    continue
                found = list(_search_block(*held, ids, vecs, codes.reshape(-1, trees), k, probe))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)],
                                                 names=["query_id", "vec_id", "score"])
    return run


def nearest(df: DataFrame, queries: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
            trees: int = 64, probe: float = 1.0, block: int = 8192, chunk: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets the SQL condition ``queries`` (on
    ``id``), its k nearest other rows found, best first, ties to the smaller id.

    ``score`` is the inner product in double precision. ``probe`` sets the recall: 1.0 finds over
    0.9 of the true neighbours even where vectors have no structure at all. Edge cases: null, zero
    or non-finite vectors and vectors of another dimension are neither queries nor candidates; with
    k or fewer candidates all are returned; rows with equal vectors have equal scores; rows that share an id
    count as one, its smallest vector; an empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    v = stage_table(valid_vectors(df, id_col, vec_col).groupBy("id").agg(F.min(F.struct("vec", "norm")).alias("x"))
                    .select("id", "x.vec", "x.norm"), "vectors")
    index, blocks = build_forest(v, k + 1, trees, block)
    asked = v.where(queries)
    chunks = max(1, -(-asked.count() // chunk))

    def gathered(c: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": [c], "ids": [ids.tobytes()], "vecs": [x.tobytes()],
                                           "codes": [_codes(x, trees, False).tobytes()]})

    q = (asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).select("chunk", "id", "vec")
         .repartition("chunk").sortWithinPartitions("chunk", "id")
         .mapInArrow(_gather("chunk", gathered), "chunk long, ids binary, vecs binary, codes binary"))
    q = stage_table(q, "queries")
    blocks_of = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    # every row is one of the index or asked of every block: a block meets its chunks in one partition
    both = index.unionByName(q.withColumn("block", blocks_of).withColumn("rows", F.lit(None).cast("binary")))
    found = (both.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "chunk")
             .mapInArrow(_search(trees, k, probe), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
