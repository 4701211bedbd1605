"""Best-fit packing of documents into sequences of several permitted lengths.

Best-fit-decreasing only looks at lengths, so it is decided on the histogram of piece lengths: at
most as many entries as the longest permitted sequence, whatever the corpus holds. The plan says,
for every run of equally long pieces, into which bins they go and where; Spark numbers the pieces
of each length and joins them to the plan. Bins of equal remaining room are one entry, and a run of
pieces fills whole groups of bins at a time, so that planning does not grow with the row count.

The lengths are optimised jointly: when nothing fits, the bin that is opened has the size of least
cost per word, judged by what the pieces still to come would fill it with (``Openings``); in the
end each bin is downsized to the smallest permitted length that holds its contents. The packings
that open one size throughout are planned as well, and the cheapest plan of all is taken. The cost
of a sequence of length L is L * (1 + L * attention), its padding included.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tricolor.llm.common import n_words, stage_table

BUCKET_ROWS = 50_000
LENGTHS = (512, 1024, 2048, 4096, 8192)


def sequence_cost(length: int, attention: float) -> float:
    return length * (1 + length * attention)


class Openings:
    """The least-cost size for bins that have to be opened.

    A bin of each permitted size is filled on paper: with the pieces at hand, then with the longest
    shorter pieces that nobody has been promised yet. The size whose downsized cost per filled word
    is least wins (ties: the smaller one), its contents are promised to it, and as many bins are
    opened alike as the promised lengths last. Every opening uses up a length or its remainder, so
    there are a few for each length. Best fit then places the shorter pieces itself: promises only
    keep the next openings from counting on the same pieces.
    """

    def __init__(self, histogram: dict[int, int], lengths: tuple[int, ...], attention: float):
        self.lengths, self.attention = lengths, attention
        self.free = dict(histogram)
        self.order = sorted(histogram)

    def _contents(self, size: int, length: int, pieces: int) -> list[tuple[int, int]]:
        own = min(pieces, size // length)
        room, content, i = size - own * length, [(length, own)], bisect_left(self.order, length)
        while (i := bisect_right(self.order, room, 0, i)) > 0:
            i -= 1
            n = self.order[i]
            take = min(self.free[n], room // n)
            content.append((n, take))
            room -= n * take
        return content

    def choose(self, length: int, pieces: int) -> tuple[int, int]:
        """(size, number of bins) for ``pieces`` pieces of ``length`` that fit nowhere."""
        best = None
        for size in self.lengths[bisect_left(self.lengths, length):]:
            content = self._contents(size, length, pieces)
            used = sum(n * k for n, k in content)
            fit = self.lengths[bisect_left(self.lengths, used)]
            key = (sequence_cost(fit, self.attention) / used, size)
            if best is None or key < best[0]:
                best = key, content
        (_, size), content = best
        count = min(pieces // content[0][1], *(self.free[n] // k for n, k in content[1:])) if content[1:] else pieces // content[0][1]
        for n, k in content[1:]:
            self.free[n] -= k * count
            if not self.free[n]:
                del self.order[bisect_left(self.order, n)]
        return size, count


class BinPlan:
    """Best fit over a histogram. ``moves`` rows: (length, first rank, end rank, first bin, pieces
    per bin, offset in the bin); bins are numbered from 0 and groups are ranges of bin numbers.
    ``opened`` is the size of every new bin (larger where a piece needs it), or chooses it."""

    def __init__(self, lengths: tuple[int, ...], opened: int | Openings):
        self.lengths, self.opened = lengths, opened
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[int, int, int]]] = {}
        self.bins = 0
        self.moves: list[tuple[int, int, int, int, int, int]] = []
        self.done: list[tuple[int, int]] = []

    def _keep(self, first: int, count: int, size: int, used: int) -> None:
        if count and size > used:
            room = size - used
            if room not in self.groups:
                insort(self.rooms, room)
                self.groups[room] = []
            self.groups[room].append((first, count, size))
        elif count:
            self.done.append((count, used))

    def _fill(self, first: int, count: int, size: int, used: int, length: int, rank: int, pieces: int) -> int:
        """Best fit goes on with the bin it has just used, so bins fill up one after the other."""
        each = (size - used) // length
        take = min(pieces, each * count)
        full, part = divmod(take, each)
        self.moves.append((length, rank, rank + take, first, each, used))
        self._keep(first, full, size, used + each * length)
        if part:
            self._keep(first + full, 1, size, used + part * length)
        rest = count - full - bool(part)
        self._keep(first + full + bool(part), rest, size, used)
        return take

    def _open(self, length: int, pieces: int) -> tuple[int, int]:
        if isinstance(self.opened, Openings):
            return self.opened.choose(length, pieces)
        size = max(self.opened, self.lengths[bisect_left(self.lengths, length)])
        return size, -(-pieces // (size // length))

    def place(self, length: int, pieces: int) -> None:
        rank = 0
        while pieces:
            i = bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                first, count, size = self.groups[room].pop()
                if not self.groups[room]:
                    del self.groups[room], self.rooms[i]
                took = self._fill(first, count, size, size - room, length, rank, pieces)
            else:
                size, count = self._open(length, pieces)
                first, self.bins = self.bins, self.bins + count
                took = self._fill(first, count, size, 0, length, rank, pieces)
            rank, pieces = rank + took, pieces - took

    def cost(self, attention: float) -> float:
        left = [(n, size - room) for room, gs in self.groups.items() for _, n, size in gs]
        fit = lambda used: self.lengths[bisect_left(self.lengths, used)]
        return sum(n * sequence_cost(fit(used), attention) for n, used in self.done + left)


def best_plan(histogram: dict[int, int], lengths: tuple[int, ...], attention: float) -> BinPlan:
    """The cheapest of the plans: the least-cost size at each opening, or one size throughout."""
    best = None
    for opened in (Openings(histogram, lengths, attention), *lengths):
        plan = BinPlan(lengths, opened)
        for length in sorted(histogram, reverse=True):
            plan.place(length, histogram[length])
        if best is None or plan.cost(attention) < best.cost(attention):
            best = plan
    return best


def _moves(spark: SparkSession, plan: BinPlan) -> DataFrame:
    return spark.createDataFrame(plan.moves or [], "n long, lo long, hi long, bin long, each long, off long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS,
         attention: float = 1 / 32768, size: str | None = None) -> DataFrame:
    """One row per piece: (id, piece, start, length, bin_id, bin_start, bin_used, bin_length).

    Size is the number of words, or the SQL expression ``size``. A document longer than the
    longest permitted sequence is cut into pieces of that length and a remainder (``start`` is the
    offset of the piece in its document); no word is dropped. ``bin_start`` is the piece's place in
    its sequence, ``bin_used`` the filled length and ``bin_length`` the permitted length the
    sequence is downsized to.

    Edge cases: a null, empty or wordless text has one piece of length 0 without a bin; null ids
    and repeated rows are packed like others (equal rows take consecutive places); an empty table
    gives an empty result. Equally long pieces are alike to best fit and take their places by hash
    of id and piece, then id. Other columns are not read.
    """
    spark = df.sparkSession
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    rows = df.select(F.col(id_col).alias("id"), (F.expr(size).cast("bigint") if size else n_words(text_col)).alias("size"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / longest) - 1, F.lit(0).cast("bigint")))))
    pieces = stage_table(pieces.select("id", "piece", (F.col("piece") * longest).alias("start"), F.least(
        F.lit(longest).cast("bigint"), F.col("size") - F.col("piece") * longest).alias("length")), "pieces")
    real = pieces.where("length > 0")
    # numbers within a length: hash buckets first, then offsets, since one length may be most rows
    buckets = max(1, real.count() // BUCKET_ROWS)
    real = real.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    counts = stage_table(real.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c")), "lengths")
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    plan = best_plan(histogram, lengths, attention)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("c").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = (real.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")) - 1)
                .join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("r")))
    # bounded by the permitted lengths, not by the rows: a few moves for each length
    moves = stage_table(_moves(spark, plan), "moves")
    at = F.col("rank") - F.col("lo")
    placed = (numbered.join(moves, (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
              .select("id", "piece", "start", "length", (F.col("bin") + F.floor(at / F.col("each"))).alias("bin_id"),
                      (F.col("off") + F.pmod(at, F.col("each")) * F.col("length")).alias("bin_start"))
              .withColumn("bin_used", F.sum("length").over(Window.partitionBy("bin_id"))))
    fit = F.lit(longest)
    for n in reversed(lengths):
        fit = F.when(F.col("bin_used") <= n, F.lit(n)).otherwise(fit)
    out = placed.withColumn("bin_length", fit.cast("bigint"))
    nothing = pieces.where("length <= 0").select("id", "piece", "start", "length", *[
        F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "bin_start", "bin_used", "bin_length")])
    return out.unionByName(nothing).withColumnRenamed("id", id_col)
