"""Exact selection by counting: the n-th smallest key of a frame, found without sorting its rows.

Rows are counted by the leading digits of a hexadecimal key; the bucket that holds the n-th key is
counted by its next digits, and so on, until it is small enough to be sorted. Every pass is one
aggregate with at most 16 ** DIGITS rows per class; the keys that reach the driver are those of one
small bucket. Selecting rows is then a plain filter, ``key <= cutoff``: rows are neither exchanged,
nor ranked, nor checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 3
KEY_DIGITS = 32      # of an md5 key
SORTED_ROWS = 2000   # a bucket of up to so many rows is sorted instead of counted


@dataclass(frozen=True)
class Cutoff:
    """The last selected row in (key, id) order; ``key`` None: no row is selected. Where a prefix of
    the key decides, ``id`` is None and the key is the largest one with that prefix."""

    key: str | None
    id: object = None

    def holds(self, key: Column, id_: Column) -> Column:
        if self.key is None:
            return F.lit(False)
        if self.id is None:
            return key <= F.lit(self.key)
        return (key < F.lit(self.key)) | ((key == F.lit(self.key)) & (id_ <= F.lit(self.id)))


@dataclass
class _Search:
    need: int             # the wanted row's place inside the bucket
    prefix: str = ""
    done: Cutoff | None = None

    def descend(self, counts: dict[str, int]) -> int:
        """Into the bucket of the wanted row; its size."""
        for digits in sorted(counts):
            if self.need <= counts[digits]:
                self.prefix += digits
                if self.need == counts[digits] or len(self.prefix) >= KEY_DIGITS:
                    self.done = Cutoff(self.prefix.ljust(KEY_DIGITS, "f"))
                return counts[digits]
            self.need -= counts[digits]
        raise ValueError("more rows wanted than there are")


def class_cutoffs(df: DataFrame, key: Column, id_: Column, group: Column, wanted: Callable[[dict], dict]) -> tuple[dict, dict]:
    """({class: rows}, {class: cutoff}) so that ``wanted(rows)[class]`` rows of each class are selected.

    ``key`` is a lower-case hexadecimal string, ``id_`` unique; rows with equal keys come in the
    order of their ids. ``group`` has few classes (NULL is one of them).
    """
    rows = df.select(group.alias("g"), key.alias("k"), id_.alias("i"))

    def count(at: dict[object, str]) -> dict:
        part = None
        for g, p in at.items():
            inside = F.col("g").eqNullSafe(F.lit(g)) & F.col("k").startswith(p) if p else F.lit(True)
            part = inside if part is None else part | inside
        depth = len(next(iter(at.values()))) if at else 0
        out: dict = {}
        for r in (rows.where(part) if depth else rows).groupBy("g", F.substring("k", depth + 1, DIGITS).alias("d")).count().collect():
            out.setdefault(r["g"], {})[r["d"]] = r["count"]
        return out

    counts = count({})
    totals = {g: sum(c.values()) for g, c in counts.items()}
    want = wanted(totals)
    searches, size = {}, {}
    for g, c in counts.items():
        s = _Search(want[g], done=None if want[g] > 0 else Cutoff(None))
        searches[g] = s
        if not s.done:
            size[g] = s.descend(c)
    while open_ := {g: s for g, s in searches.items() if not s.done}:
        for g, s in open_.items():
            if size[g] <= SORTED_ROWS:
                bucket = rows.where(F.col("g").eqNullSafe(F.lit(g)) & F.col("k").startswith(s.prefix)).select("k", "i").collect()
                last = sorted((r["k"], r["i"]) for r in bucket)[s.need - 1]
                s.done = Cutoff(*last)
        open_ = {g: s for g, s in open_.items() if not s.done}
        if open_:
            deeper = count({g: s.prefix for g, s in open_.items()})
            for g, s in open_.items():
                size[g] = s.descend(deeper[g])
    return totals, {g: s.done for g, s in searches.items()}


def cutoff(df: DataFrame, key: Column, id_: Column, wanted: Callable[[int], int]) -> tuple[int, Cutoff]:
    """(rows, cutoff) that selects the ``wanted(rows)`` smallest keys of the whole frame."""
    totals, cuts = class_cutoffs(df, key, id_, F.lit(0), lambda n: {g: wanted(x) for g, x in n.items()})
    return totals.get(0, 0), cuts.get(0, Cutoff(None))
