"""Distributed numbering and running sums without a single-partition window over the rows.

``Window.orderBy(...)`` with no partition moves every row into one task. Instead:

1. ``repartitionByRange(keys)`` + ``sortWithinPartitions(keys)``: partition ``i`` holds the
   ``i``-th key range, sorted (AQE sizes and coalesces the ranges from the data);
2. ``monotonically_increasing_id()`` then encodes (partition, position in partition);
3. the frame is checkpointed into the shared checkpoint folder, so counts and positions come
   from one fixed layout (and lineage is cut: a lost executor re-reads, not re-samples); the
   input is persisted meanwhile, so range sampling does not evaluate the upstream plan twice;
4. per-partition totals are summed up by a window over the small relation that has one row per
   range (P is ours to choose), which is joined back. Nothing is collected.

With unique keys the result is the exact global rank whatever the range bounds are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tricolor.session import cut_lineage

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1

def _range_tagged(df: DataFrame, order_cols: Sequence, num_partitions: int | None,
                  persist_input: bool = True) -> DataFrame:
    # Range partitioning samples its input in a job of its own; persisting the input for the
    # duration lets the sample and the shuffle share one evaluation of an expensive upstream
    # plan. For a bare table scan re-reading is cheaper than caching (persist_input=False).
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if persist_input else df
    try:
        # without an explicit count AQE sizes the ranges from the data (adjacent ranges are
        # coalesced, which keeps the order); positions are taken after that, on the final layout
        ranged = (src.repartitionByRange(int(num_partitions), *order_cols) if num_partitions
                  else src.repartitionByRange(*order_cols))
        tagged = (ranged.sortWithinPartitions(*order_cols)
                  .withColumn("_tc_mid", F.monotonically_increasing_id()))
        tagged = cut_lineage(tagged)
    finally:
        if persist_input:
            src.unpersist()
    return (tagged
            .withColumn("_tc_pid", F.shiftrightunsigned("_tc_mid", _POS_BITS).cast("int"))
            .withColumn("_tc_pos", F.col("_tc_mid").bitwiseAND(F.lit(_POS_MASK))))


def partition_offsets(totals: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """(_tc_pid, value totals) -> exclusive prefix sums ``_tc_off_<value>`` in partition order.

    One row per range: the window runs over this relation, never over the ranked rows.
    """
    before = Window.orderBy("_tc_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_tc_pid", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_tc_off_{v}") for v in value_cols])


def _offset_table(t: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    return partition_offsets(t.groupBy("_tc_pid").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in value_cols]), value_cols)


def _join_back(df: DataFrame, ranked: DataFrame, key_cols: Sequence[str], out: str) -> DataFrame:
    """Null-safe equi-join of the ranked keys back to the full rows."""
    a, b = df.alias("_tc_a"), ranked.alias("_tc_b")
    cond = None
    for k in key_cols:
        c = F.col(f"_tc_a.`{k}`").eqNullSafe(F.col(f"_tc_b.`{k}`"))
        cond = c if cond is None else cond & c
    return a.join(b, cond).select(*[F.col(f"_tc_a.`{c}`") for c in df.columns], F.col(f"_tc_b.`{out}`"))


def ordered_rank_n(df: DataFrame, order_cols: Sequence, out: str = "rank",
                   num_partitions: int | None = None, persist_input: bool = True) -> tuple[DataFrame, int]:
    """``ordered_rank`` plus the row count (read from the checkpointed layout)."""
    t = _range_tagged(df, order_cols, num_partitions, persist_input).withColumn("_tc_one", F.lit(1))
    # the offsets have one row per range partition: a bound we chose, not one that the data sets
    ranked = t.join(F.broadcast(_offset_table(t, ["_tc_one"])), "_tc_pid")
    return ranked.select(*df.columns, (F.col("_tc_off__tc_one") + F.col("_tc_pos") + 1).alias(out)), t.count()


def ordered_rank(df: DataFrame, order_cols: Sequence, out: str = "rank",
                 num_partitions: int | None = None, persist_input: bool = True,
                 key_cols: Sequence[str] | None = None) -> DataFrame:
    """Append ``out`` = 1..n in the order of ``order_cols`` (which must be unique).

    With ``key_cols`` (a unique key from which ``order_cols`` are computed) only the keys are
    ranked and checkpointed, then joined back: for wide tables this avoids writing every column
    to the checkpoint, and later passes stay column-pruned on the source.
    """
    if key_cols is not None and len(key_cols) < len(df.columns):
        keys = df.select(*[F.col(f"`{k}`") for k in key_cols])
        ranked = ordered_rank(keys, order_cols, out, num_partitions, persist_input)
        return _join_back(df, ranked, key_cols, out)
    t = _range_tagged(df, order_cols, num_partitions, persist_input).withColumn("_tc_one", F.lit(1))
    ranked = t.join(F.broadcast(_offset_table(t, ["_tc_one"])), "_tc_pid")
    return ranked.select(*df.columns, (F.col("_tc_off__tc_one") + F.col("_tc_pos") + 1).alias(out))


def rank_within(df: DataFrame, group_col: str, order_cols: Sequence, out: str = "rank",
                num_partitions: int | None = None, key_cols: Sequence[str] | None = None) -> DataFrame:
    """Rank 1..n_g inside each group, whatever the number and size of the groups.

    A per-group window would put a whole class in one task; here the global rank over
    (group, keys) minus the group's smallest one gives the same number.
    """
    ranked = ordered_rank(df, [F.col(group_col).asc_nulls_first(), *order_cols], "_tc_grank",
                          num_partitions, key_cols=[group_col, *key_cols] if key_cols else None)
    firsts = ranked.groupBy(F.col(group_col).alias("_tc_group")).agg(F.min("_tc_grank").alias("_tc_first"))
    j = ranked.join(firsts, F.col(group_col).eqNullSafe(F.col("_tc_group")))
    return j.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_tc_grank") - F.col("_tc_first") + 1).alias(out))


def ordered_running_sum(df: DataFrame, order_cols: Sequence, value_cols: Sequence[str],
                        prefix: str = "cum_", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in the order of ``order_cols`` (unique keys)."""
    t = _range_tagged(df, order_cols, num_partitions)
    w = Window.partitionBy("_tc_pid").orderBy("_tc_mid").rowsBetween(Window.unboundedPreceding, 0)
    within = t.select("*", *[F.sum(v).over(w).alias(f"_tc_in_{v}") for v in value_cols])
    out = within.join(F.broadcast(_offset_table(t, value_cols)), "_tc_pid")
    return out.select(*df.columns,
                      *[(F.col(f"_tc_off_{v}") + F.col(f"_tc_in_{v}")).alias(f"{prefix}{v}")
                        for v in value_cols])


def add_row_id(df: DataFrame, key_cols: Sequence[str] | None = None, id_col: str = "row_id",
               num_partitions: int | None = None, persist_input: bool = True,
               narrow: bool = False) -> DataFrame:
    """Prepend ``row_id`` = 1..n ordered by a declared unique key, unless already present.

    Without a key, the whole row is the key (the only unique key some tables have).
    ``narrow=True`` ranks only the key columns and joins the ids back (wide tables).
    """
    if id_col in df.columns:
        return df
    keys = list(key_cols) if key_cols else list(df.columns)
    ranked = ordered_rank(df, [F.col(f"`{k}`") for k in keys], id_col, num_partitions, persist_input,
                          key_cols=keys if narrow else None)
    return ranked.select(id_col, *df.columns)
