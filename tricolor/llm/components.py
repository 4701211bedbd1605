"""Connected components of a distributed edge list by alternating large-star and small-star.

Both steps turn each edge into one edge, so that the list never grows; equal edges are united once a
round. A round is five shuffles of (vertex, vertex) pairs and one written table. As soon as every
vertex has a single smaller neighbour, the edges are trees, and rounds of two shuffles halve their
depth. No component or edge list reaches the driver, not to be broadcast either (ends are few bytes in a file
and many in a hash table); it only learns after each round, by one more shuffle, what is left to do. Minima are pre-aggregated before the shuffle; the join back is an ordinary
equi-join. Adaptive execution can split a hub vertex only in the rounds on trees, where no aggregate stands
between shuffle and join; in the others one task sorts and streams a hub's distinct edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.llm.common import stage_table


def _lowest(e: DataFrame) -> DataFrame:
    """(x, m): the smallest lower neighbour of every vertex that has one."""
    return e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """The upper end of every edge moves to the smallest neighbour of the lower end."""
    return e.join(_lowest(e).hint("merge"), F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """The lower neighbours of every vertex, and itself in place of the smallest, move to the smallest."""
    return (e.join(_lowest(e).hint("merge"), F.col("u") == F.col("x"))
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))


def _halved(e: DataFrame) -> DataFrame:
    """Trees of half the depth: the upper end of every edge moves to the lower end's only lower neighbour."""
    up = e.where("u <> v").select(F.col("u").alias("x"), F.col("v").alias("m"))
    return e.join(up.hint("merge"), F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _left_to_do(e: DataFrame) -> tuple[bool, bool]:
    """Whether a vertex has several smaller neighbours, and whether one has some and is one itself."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                             F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    seen = (e.where("u <> v").select(ends.alias("end")).groupBy("end.x")
            .agg(F.sum("end.up").alias("ups"), F.max("end.down").alias("down"))
            .agg(F.max(F.col("ups") > 1).alias("several"), F.max((F.col("ups") > 0) & (F.col("down") > 0)).alias("deep")).first())
    return bool(seen["several"]), bool(seen["deep"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex of ``edges``; component is the smallest vertex reachable.

    Null ends are ignored; a vertex that only has self loops is its own component; no edges give
    no rows.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = stage_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    several = deep = True
    while several or deep:
        e = stage_table(_small_star(_large_star(e)).distinct() if several else _halved(e), "cc")
        several, deep = _left_to_do(e)
    # a self loop stays at a root and becomes an edge elsewhere
    return (e.where("u <> v").select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
