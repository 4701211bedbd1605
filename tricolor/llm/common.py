"""Shared pieces: word rule, vectorised hashing of Arrow text, scratch tables, grouped batches.

A word is a maximal run of characters other than space and U+0009..U+000D; A-Z is lower-cased
before hashing. Words are hashed straight from the Arrow buffers (no Python string per word),
in segments of about a megabyte, so that memory does not grow with the text or the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tricolor.session import scratch_path, ship_package

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT_BYTES = 1 << 19
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_RND = np.random.default_rng(20260117).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str | Column) -> Column:
    """Array of the words of a text (empty for a null text)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(text: str | Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: the plan is evaluated a
    single time and a lost executor only re-reads files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark clean up the exchanges of
    finished jobs: their files go once the driver has collected the plans that refer to them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Before Python runs in tasks: the package goes along, and Arrow batches are kept to
    ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` (a larger row is one), since rows hold whole texts
    here and workers share an executor's memory."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def give_back() -> None:
    """Memory that freed arrays have left in this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
    if trim is not None:
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn`` for mapInArrow, whose worker keeps nothing of a partition that has ended: workers stay
    for the tasks of later stages, and what each has once needed would count beside what the next need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()
    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = np.array(x, dtype=np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of a batch of texts: word ``i`` is bytes [start, end) of ``data``; text ``d`` has the
    words ptr[d]..ptr[d+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    prefixes: dict[int, np.ndarray]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def hash_words(column: pa.Array, prefixes: tuple[int, ...] = ()) -> Words:
    """Hash every word; ``prefixes`` also asks for hashes of the first n bytes of each word."""
    data, bounds = text_buffers(column)
    n, at = len(data), 0
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    starts, ends, hashes = [], [], []
    pre: dict[int, list] = {p: [] for p in prefixes}
    while at < n:
        to = min(n, at + SEGMENT_BYTES)
        while to < n and not (_SEP[data[to]] or first[to]):  # never cut inside a word
            step = data[to:to + 65536]
            hit = np.flatnonzero(_SEP[step] | first[to:to + len(step)])
            to = to + int(hit[0]) if len(hit) else to + len(step)
        seg = data[at:to]
        word = ~_SEP[seg]
        new = first[at:to].copy()
        new[0] = True
        start = word & new
        start[1:] |= word[1:] & ~word[:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | new[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        power, inverse = _powers(len(seg) + 1)
        c = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_RND[_LOW[seg]] * power[:len(seg)], out=c[1:])
        back = inverse[s]
        hashes.append(mix((c[e] - c[s]) * back + (e - s).astype(np.uint64)))
        for p in prefixes:
            q = np.minimum(s + p, e)
            pre[p].append(mix((c[q] - c[s]) * back + _U(p << 40)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return Words(data, start, np.concatenate(ends) if ends else np.zeros(0, np.int64),
                 np.searchsorted(start, bounds), cat(hashes), bounds, {p: cat(v) for p, v in pre.items()})


def shingle_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k-word shingle at every position, pointer per text). A text with 1..k-1 words
    has its whole sequence as one shingle; a text without words has none."""
    n = np.diff(w.ptr)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    ptr = np.concatenate([[0], np.cumsum(count)])
    total = int(ptr[-1])
    out = np.empty(total, np.uint64)
    if not total:
        return out, ptr
    # position of each shingle's first word
    at = np.arange(total) - np.repeat(ptr[:-1] - w.ptr[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    acc = np.zeros(total, np.uint64)
    last = len(w.hash) - 1
    for j in range(k):
        h = w.hash[np.minimum(at + j, last)]
        acc = np.where(j < size, mix(acc * _BASE + h), acc)
    return mix(acc + size.astype(np.uint64)), ptr


def slices(batch: pa.RecordBatch, text: str, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``target`` text bytes."""
    _, bounds = text_buffers(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + target, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1,
         most_bytes: int = 1 << 62) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are contiguous by ``keys`` (partitions sorted by them), gathered
    to at least ``rows`` rows: yields (table, first row of each group and the end)."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        c = cuts(t)
        if len(c) > 2:
            cut = int(c[-2])
            yield t.slice(0, cut), c[:-1]
            held = t.slice(cut).combine_chunks().to_batches()
            count = t.num_rows - cut
        else:
            count = t.num_rows
    if held:
        t = pa.Table.from_batches(held)
        yield t, cuts(t)


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    off = np.arange(len(rows) + 1, dtype=np.int64) * width
    if off[-1] >= 1 << 31:
        return pa.array([r.tobytes() for r in rows], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(rows),
                                 [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def binary_rows(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """The reverse: a 2-d array from a binary column without nulls whose rows are ``width`` long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), dtype)
    wide = pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[o[0]:o[-1]].view(dtype).reshape(len(column), width)
