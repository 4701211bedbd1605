"""Sharding by histogram sort: balanced shards of a key order, found by counting alone.

Candidate boundaries (probes) are points of the key order. Every round counts the exact bytes and
rows below each probe (searchsorted and one partial sum per batch, added up in Spark), brackets
every wanted splitter between two probes and places new probes inside, until all splitters meet the
tolerance. Only then do rows move, once, each to the task of its key range.

Keys may repeat (one key may hold a third of all rows): the order is (key, row number of the
written table), so a splitter can fall inside a key. A shard is a run of several ranges of about
``range_bytes`` each, so that no task has to hold a shard. Only the boundaries between shards are
refined to the tolerance; those inside a shard may be off by a quarter of a range. Splitters with the
same bracket share its probes, a round has at most about ``MOST_PROBES`` of them, a bracket of one row is
closed, and the rest of a round is a binary search for each open splitter: the driver's work is
near linear in the ranges, and the rounds are bounded by the bits of key and row number.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tricolor.llm.common import ship, stage_table, unused

PROBES = 15
MOST_PROBES = 1 << 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
Point = tuple[int, int]   # key, row number


def _columns(points: list[Point]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p[0] for p in points], np.int64), np.array([p[1] for p in points], np.int64)


def _below(points: tuple[np.ndarray, np.ndarray], key: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """For each row, the number of (sorted) points at or before it."""
    pk, pu = points
    lo, hi = np.searchsorted(pk, key, "left"), np.searchsorted(pk, key, "right")
    at = lo.copy()
    for i in np.unique(lo[hi > lo]):
        rows = np.flatnonzero((lo == i) & (hi > lo))
        at[rows] = i + np.searchsorted(pu[i:hi[rows[0]]], uid[rows], "right")
    return at


def _count(keys: DataFrame, probes: list[Point]) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) between consecutive probes; one small row per probe and task moves."""
    at_probe, parts = _columns(probes), len(probes) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
        for b in batches:
            at = _below(at_probe, b.column("key").to_numpy(), b.column("uid").to_numpy())
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=parts)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["at", "size", "n"])

    size, n = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    for r in (keys.mapInArrow(run, "at long, size long, n long").groupBy("at")
              .agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()):
        size[r["at"]], n[r["at"]] = r["size"], r["n"]
    return size, n


def _between(lo: Point, hi: Point, count: int, last_uid: int) -> list[Point]:
    """At most ``count`` points evenly inside (lo, hi) of the (key, row number) order."""
    if hi[0] - lo[0] > 1:
        found = [(lo[0] + max(1, (hi[0] - lo[0]) * i // (count + 1)), _LEAST) for i in range(1, count + 1)]
    elif hi[0] > lo[0]:  # two neighbouring keys: the end of the lower one, and points inside it
        found = [(hi[0], _LEAST)] + [(lo[0], p) for p in _span(lo[1], last_uid + 1, count)]
    else:
        found = [(lo[0], p) for p in _span(lo[1], hi[1], count)]
    return sorted({p for p in found if lo < p < hi})


def _span(lo: int, hi: int, count: int) -> list[int]:
    lo = max(lo, -1)  # row numbers are not negative
    return [lo + max(1, (hi - lo) * i // (count + 1)) for i in range(1, count + 1)]


def refine(count: Callable[[list[Point]], tuple[np.ndarray, np.ndarray]], lo: Point, hi: Point, total: int, rows: int,
           last_uid: int, want: list[int], tolerance: list[int]) -> tuple[list[Point], int]:
    """For each wanted number of bytes a point with about so many below it: within its tolerance, or
    the nearest end of the one row it falls into. ``count`` gives bytes and rows between given probes; all
    ``total`` bytes and ``rows`` rows are in [lo, hi). Also the rounds used."""
    bracket = [((lo, 0, 0), (hi, total, rows)) for _ in want]   # (point, bytes below, rows below)

    def off(i: int) -> int:
        (_, x, _), (_, y, _) = bracket[i]
        return min(want[i] - x, y - want[i])

    is_open = [i for i in range(len(want)) if off(i) > tolerance[i] and rows > 1]
    rounds = 0
    while is_open:
        pairs = {(bracket[i][0][0], bracket[i][1][0]) for i in is_open}
        each = max(1, min(PROBES, MOST_PROBES // len(pairs)))
        probes = sorted({p for a, b in pairs for p in _between(a, b, each, last_uid)})
        if not probes:
            break
        rounds += 1
        size, n = count(probes)
        upto, seen = np.cumsum(size)[:-1].tolist(), np.cumsum(n)[:-1].tolist()
        still = []
        for i in is_open:
            low, high = bracket[i]
            j = bisect_right(upto, want[i]) - 1
            if j >= 0 and probes[j] > low[0]:
                low = (probes[j], upto[j], seen[j])
            if j + 1 < len(probes) and probes[j + 1] < high[0]:
                high = (probes[j + 1], upto[j + 1], seen[j + 1])
            bracket[i] = (low, high)
            if off(i) > tolerance[i] and high[2] - low[2] > 1:
                still.append(i)
        is_open = still
    return [a[0] if want[i] - a[1] <= b[1] - want[i] else b[0] for i, (a, b) in enumerate(bracket)], rounds


def splitters(keys: DataFrame, shards: int, each: int, tolerance: float) -> tuple[list[Point], int]:
    """``shards * each - 1`` points: every ``each``-th is within ``tolerance`` of a shard's bytes of equal
    shares (or the nearest there is, rows being whole), the others within a quarter of a range."""
    total, rows, lo, hi, last = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.min("key"), F.max("key"),
                                         F.max("uid")).first()
    parts = shards * each
    if not total or parts < 2:
        return [], 0
    want = [total * i // parts for i in range(1, parts)]
    tight, loose = max(1, int(tolerance * total / shards)), max(1, total // parts // 4)
    end = (hi + 1, _LEAST) if hi < _MOST else (hi, last + 1)
    points, rounds = refine(lambda probes: _count(keys, probes), (lo, _LEAST), end, total, rows, last, want,
                            [loose if i % each else min(tight, loose) for i in range(1, parts)])
    return sorted(points), rounds


def histogram_shards(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", shards: int = 16,
                     range_bytes: int = 32 << 20, tolerance: float = 0.001) -> DataFrame:
    """The rows of ``df`` with size, shard and slot, each key range in its own task, sorted.

    ``size`` is the UTF-8 bytes of the text plus 1; shard sizes are equal up to ``tolerance`` of a
    shard (or one row, if rows are larger); ``slot`` counts from 0 without gaps in a shard, in the
    order of the (integer) key.

    Edge cases: a null text has size 1; a very long text is one row like others, whole in one shard;
    a null key sorts first; equal keys and repeated rows follow each other in no particular order, may be
    split between shards, and are each placed once; an empty table gives an empty result; columns that
    clash with size, shard or slot are replaced, all others are kept.
    """
    spark = df.sparkSession
    ship(spark)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1
    uid_, key_, part_ = (unused(df, c) for c in ("__uid", "__key", "__part"))
    # row numbers must not change between counting and moving: they are written with the rows
    rows = stage_table(df.drop("size", "shard", "slot").withColumn(uid_, F.monotonically_increasing_id())
                       .withColumn("size", size).withColumn(key_, F.coalesce(F.col(key_col).cast("bigint"), F.lit(_LEAST))), "rows")
    keys = rows.select(F.col(key_).alias("key"), F.col(uid_).alias("uid"), "size")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = max(1, round(total / shards / range_bytes))
    points, _ = splitters(keys, shards, each, tolerance)
    _, count = _count(keys, points) if points else (None, np.zeros(shards * each, np.int64))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    first = first - first[np.arange(len(first)) // each * each]
    at_point = _columns(points)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(part_, pa.array(_below(at_point, b.column(key_).to_numpy(), b.column(uid_).to_numpy())))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            part = b.column(part_).to_numpy()
            slot = np.empty(b.num_rows, np.int64)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                slot[at] = first[p] + seen.get(p, 0) + np.arange(len(at))
                seen[p] = seen.get(p, 0) + len(at)
            out = b.drop_columns([part_, key_, uid_])
            yield out.append_column("shard", pa.array((part // each).astype(np.int32))).append_column("slot", pa.array(slot))

    placed = rows.mapInArrow(place, StructType([*rows.schema.fields, StructField(part_, LongType())]))
    moved = placed.repartitionById(shards * each, F.col(part_).cast("int")).sortWithinPartitions(part_, key_, uid_)
    back = [f for f in rows.schema.fields if f.name not in (uid_, key_, part_)]
    return moved.mapInArrow(slots, StructType([*back, StructField("shard", IntegerType()), StructField("slot", LongType())]))
