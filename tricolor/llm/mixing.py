"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

A source's documents lie end to end in a shuffled order (by md5 of the id); its stream, repeated
up to ``repeats`` times, is cut into blocks of ``block`` words. Slot j of the mix has the golden
ratio point frac(j * 0.618...), which falls into one source's share of the unit interval; the r-th
slot of a source takes its r-th block. Points of an additive golden-ratio sequence spread so evenly
that a source's slots differ from its share by a few only; what is missing at the end is appended,
what is beyond the target is left out, and the last block is cut at the target.

Plan: running sums and ranks are two-level (hash buckets or slot chunks first, then offsets over
the small table of buckets), so that one source with most of the rows is still many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tricolor.llm.common import n_words, stage_table, unused, words

# Fixed value: 2**32 / golden ratio, rounded to an odd number.
GOLDEN_32 = 2654435769
CHUNK = 1 << 16
CELLS = 4096
BUCKET_ROWS = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, sidx, weight, target).

    Sources in code point order, null last, weigh ``weights`` in turn. Targets share the sum of all
    sizes by weight; none is above ``repeats`` times its source's size, the excess is shared again.
    The level is found in closed form: sources sorted by cap per weight, and the first whose cap
    covers its share of what the ones before it leave sets the level for all from there on.
    One row per source: the windows run over this small table, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(int(w)) for w in weights])
    s = (sizes.withColumn("sidx", F.row_number().over(order))
         .withColumn("weight", F.get(picks, (F.col("sidx") - 1) % len(weights)))
         .withColumn("cap", F.col("source_size") * repeats))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "sidx")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
         .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("share", F.col("left") / F.sum("weight").over(after))
         .withColumn("nth", F.row_number().over(by)))
    level = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("nth", "share"))).over(Window.partitionBy())
    return (s.withColumn("level", level["share"])
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
            .select("source", "source_size", "sidx", "weight", "target"))


def _schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """(sidx, rank, slot): which slot of the mix takes the rank-th block of each source."""
    spark = sources.sparkSession
    n = -(-total // block)
    by = Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, -1)
    shares = (sources.withColumn("quota", F.ceil(F.floor("target") / block))
              .withColumn("lo", F.coalesce(F.sum("target").over(by), F.lit(0.0)))
              .withColumn("hi", F.col("lo") + F.col("target")).where("quota > 0"))
    whole = float(total)
    cell = shares.select("sidx", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / whole * CELLS), F.least(F.floor(F.col("hi") / whole * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), (F.pmod(
        (F.col("id") % (1 << 31)) * GOLDEN_32, F.lit(1 << 32)) / float(1 << 32)).alias("x"))
    hit = (points.withColumn("cell", F.floor(F.col("x") * CELLS)).join(cell, "cell")
           .where((F.col("x") * whole >= F.col("lo")) & (F.col("x") * whole < F.col("hi")))
           .select("sidx", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk")))
    counts = hit.groupBy("sidx", "chunk").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("sidx", "chunk", F.coalesce(F.sum("c").over(
        Window.partitionBy("sidx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    ranked = (hit.withColumn("r", F.row_number().over(Window.partitionBy("sidx", "chunk").orderBy("slot")) - 1)
              .join(offsets, ["sidx", "chunk"]).select("sidx", (F.col("off") + F.col("r")).alias("rank"), "slot"))
    have = counts.groupBy("sidx").agg(F.sum("c").alias("have"))
    missing = (shares.join(have, "sidx", "left").withColumn("have", F.coalesce("have", F.lit(0)))
               .where("have < quota").select("sidx", F.explode(F.sequence(F.col("have"), F.col("quota") - 1)).alias("rank"))
               .withColumn("slot", F.lit(n) + F.col("rank")))
    return (ranked.join(shares.select("sidx", "quota"), "sidx").where("rank < quota").select("sidx", "rank", "slot")
            .unionByName(missing))


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(sized, taken): per row of ``df`` (id, tie, size, source_size, target, sidx, start) and per
    (row, slot) what that slot of the mix takes of it (sidx, start, rank, slot, epoch, words).

    Edge cases: null text has size 0 and is never taken; a null source is a source, the last one;
    null ids and repeated rows are rows like any other (ties by size and text hash); when all sizes
    are 0 every target is 0; an empty table gives empty results. A text longer than a block is taken
    by as many slots as it has blocks. Other columns are not read.
    """
    spark = df.sparkSession
    rows = stage_table(df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("place"),
        F.xxhash64(text_col).alias("tie")), "sizes")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    sources = stage_table(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "sources")
    # order-preserving buckets: leading hex digits of the place, so many that a bucket stays small
    digits = max(1, math.ceil(math.log(max(n, 1) / BUCKET_ROWS + 1, 16)))
    placed = (rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
              .withColumn("bucket", F.substring("place", 1, digits)))
    offsets = (placed.groupBy("sidx", "bucket").agg(F.sum("size").alias("c"))
               .select("sidx", "bucket", F.coalesce(F.sum("c").over(
                   Window.partitionBy("sidx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off")))
    inside = Window.partitionBy("sidx", "bucket").orderBy("place", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    sized = stage_table(
        placed.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["sidx", "bucket"])
        .select("id", "source", "tie", "size", "source_size", "target", "sidx",
                (F.col("off") + F.col("upto") - F.col("size")).alias("start")), "placed")
    if not total:
        return sized, spark.createDataFrame([], "sidx int, start long, rank long, slot long, epoch int, words long")
    lo = F.col("start") + F.col("epoch") * F.col("source_size")
    parts = (sized.where("size > 0")
             .select("sidx", "start", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"))
             .withColumn("lo", lo).withColumn("hi", F.least(lo + F.col("size"), F.floor("target"))).where("lo < hi")
             .withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
             .select("sidx", "start", "epoch", "rank",
                     (F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block)).alias("words")))
    taken = parts.join(_schedule(sources, total, block), ["sidx", "rank"]).select("sidx", "start", "rank", "slot", "epoch", "words")
    return sized, taken


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of ``df``: id, size, source_size, target, taken (words the mix takes of it,
    repeats counted; at most ``repeats`` times its size), first_slot and n_parts (the first slot of
    the mix that takes of it, null if none does, and in how many portions it is taken, one for each
    block and repeat). Edge cases: see ``mix_plan``."""
    sized, taken = mix_plan(df, id_col, text_col, source_col, **how)
    got = taken.groupBy("sidx", "start").agg(
        F.sum("words").alias("w"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_parts"))
    return (sized.join(got.withColumnRenamed("sidx", "s").withColumnRenamed("start", "b"),
                       (F.col("sidx") == F.col("s")) & (F.col("start") == F.col("b")) & (F.col("size") > 0), "left")
            .select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("w", F.lit(0)).cast("bigint").alias("taken"),
                    "first_slot", F.coalesce("n_parts", F.lit(0)).cast("bigint").alias("n_parts")))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for every time a document is taken, in the
    order of the schedule (ranges of slots, each sorted by the slot that takes the row's first word),
    so that every stretch of the written mix holds the sources in about their shares.

    A document taken whole keeps its text; the one document per source at which the target cuts
    has the words up to the cut. Documents without words have nothing to take and are left out, as
    are those beyond their source's target. Rows equal in id, source and text are told apart by
    their place only.
    """
    sized, taken = mix_plan(df, id_col, text_col, source_col, **how)
    id_, source, tie, size, take, slot, place, own = (
        unused(df, f"mix_{c}") for c in ("id", "source", "tie", "size", "take", "slot", "place", "own_tie"))
    # a row's first word lies in the first of its blocks, whatever slots the later ones go to
    per = taken.groupBy("sidx", "start", "epoch").agg(F.sum("words").alias(take), F.min_by("slot", "rank").alias(slot))
    rows = (sized.where("size > 0").join(per, ["sidx", "start"])
            .select(F.col("id").alias(id_), F.col("source").alias(source), F.col("tie").alias(tie), F.col("size").alias(size), take, slot,
                    F.col("start").alias(place)))
    # equal rows are one text here, and each of their places takes it
    docs = df.withColumn(own, F.xxhash64(text_col)).dropDuplicates([id_col, source_col, own])
    joined = docs.join(rows, docs[id_col].eqNullSafe(rows[id_]) & docs[source_col].eqNullSafe(rows[source]) & (docs[own] == rows[tie]))
    cut = F.array_join(F.slice(words(text_col), F.lit(1), F.col(take).cast("int")), " ")
    text = F.when(F.col(take) < F.col(size), cut).otherwise(F.col(text_col))
    out = joined.withColumn(text_col, text)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType))
    return out.repartitionByRange(slot).sortWithinPartitions(slot, place).select(*df.columns)
