"""A JSON array of objects read by many tasks.

An array has no line that a task could start at: whether a brace opens a record depends on every
character before it. The file is read in pieces that end at ``}``, which Spark's text source splits
by byte ranges, and what a piece does to the parser is summarised without knowing where it starts:
its unescaped quotes (a state in or out of a string flips with each) and its change of depth for
both states. Such summaries compose, so running sums, first inside a byte range and then over the
small relation of ranges, give each range the state it begins in. With that state the text is
passed a second time: a record ends where a piece closes back to depth 1. Records inside a range
are put together in its task; the pieces of the few that cross ranges are exchanged.

Valid JSON needs no more than this: a backslash stands only in strings, and never before ``}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tricolor.session import cut_lineage, scratch_path

RANGE = ["file", "start"]


def _depth(parts: Column) -> Column:
    text = F.array_join(parts, "")
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n, value, quotes, outside, inside): pieces in their order, with the change of
    depth inside them when they begin outside or inside a string."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"))
    runs = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    return raw.withColumn("runs", runs).select(
        *RANGE, "n", "value", (F.size("runs") - 1).cast("bigint").alias("quotes"),
        _depth(F.filter("runs", lambda _, i: i % 2 == 0)).alias("outside"),
        _depth(F.filter("runs", lambda _, i: i % 2 == 1)).alias("inside"))


def _state(pieces: DataFrame, entry: Column) -> DataFrame:
    """``out`` (the piece ends outside a string) and ``change`` (of depth, its closing brace included)
    of pieces whose range begins in state ``entry`` (0 outside, 1 inside a string)."""
    before = Window.partitionBy(*RANGE).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    begins = (entry + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2
    return (pieces.withColumn("begins", begins).withColumn("out", (F.col("begins") + F.col("quotes")) % 2 == 0)
            .withColumn("change", F.when(F.col("begins") == 0, F.col("outside")).otherwise(F.col("inside"))
                        - F.col("out").cast("int")))


def _ranges(pieces: DataFrame) -> DataFrame:
    """(file, start, entry, depth): the state in which each byte range begins; a row for each range."""
    narrow = pieces.select(*RANGE, "n", "quotes", "outside", "inside")
    # a range's change of depth for both states it may begin in
    both = _state(narrow, F.lit(0)).withColumn("other", F.when(F.col("begins") == 0, F.col("inside")).otherwise(
        F.col("outside")) - (~F.col("out")).cast("int"))
    sums = both.groupBy(*RANGE).agg(F.sum("quotes").alias("quotes"), F.sum("change").alias("c0"), F.sum("other").alias("c1"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return (sums.withColumn("entry", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
            .withColumn("change", F.when(F.col("entry") == 0, F.col("c0")).otherwise(F.col("c1")))
            .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))).select(*RANGE, "entry", "depth"))


def _joined(order: Column) -> list[Column]:
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("value").alias("v"))))
    return [F.array_join(F.transform(parts, lambda p: p["v"]), "}").alias("value"), F.max("ends").alias("ends")]


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of each object of the JSON arrays at ``path``, one array for each file.

    Objects may be nested, span lines and hold braces, brackets, quotes and escapes in strings. An
    empty array or file has no records. Elements that are not objects, and nested arrays as
    elements, are not records and not supported. A byte range is one task's work and is bounded by
    ``spark.sql.files.maxPartitionBytes``; a file compressed as a whole is one range.
    """
    pieces = _pieces(spark, path)
    ranges = cut_lineage(_ranges(pieces))
    tasks = max(1, ranges.count())
    upto = Window.partitionBy(*RANGE).orderBy("n")
    rows = _state(pieces.repartition(tasks, *RANGE).join(ranges, RANGE), F.col("entry"))
    rows = (rows.withColumn("after", F.col("depth") + F.sum("change").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("ends", F.col("out") & (F.col("after") == 1))
            .withColumn("rec", F.coalesce(F.count_if("ends").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    local = (rows.groupBy(*RANGE, "rec", "entry", "depth").agg(*_joined(F.col("n")))
             .withColumn("begins", (F.col("rec") > 0) | (F.col("entry") + F.col("depth") == 0)
                         | ((F.col("entry") == 0) & (F.col("depth") == 1))))
    whole = local.where("begins and ends").select("value")
    # at most two fragments a range: numbered without their texts, then joined to them
    cut = local.where("not (begins and ends)")
    nth = Window.partitionBy("file").orderBy("start", "rec").rowsBetween(Window.unboundedPreceding, 0)
    marks = cut.select(*RANGE, "rec", F.count_if("begins").over(nth).alias("record"))
    crossing = (cut.join(marks, [*RANGE, "rec"]).groupBy("file", "record")
                .agg(*_joined(F.struct("start", "rec"))).where("ends").select("value"))
    text = F.expr("substring(value, locate('{', value))")
    return whole.unionByName(crossing).select(F.concat(text, F.lit("}")).alias("value"))


def read_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The records of the JSON arrays at ``path`` as columns. Without a schema the records are
    written once as JSON Lines, a line break between tokens being a space, and typed by Spark."""
    records = array_records(spark, path)
    if schema is not None:
        return records.select(F.from_json("value", schema).alias("r")).select("r.*")
    lines = scratch_path(spark, "json_lines")
    records.select(F.translate("value", "\r\n", "  ").alias("value")).write.mode("overwrite").text(lines)
    return spark.read.json(lines)
