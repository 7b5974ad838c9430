"""Connected components by alternating large-star and small-star steps; every step is joins and aggregates.

An edge joins a vertex `a` to a smaller one `b`. A large-star step hangs each `a` under the smallest vertex known to
its `b`; a small-star step hangs all smaller neighbours of a vertex under the least of them. Minima come from
aggregates that combine before they shuffle. They return by a join between two shuffled tables, which
adaptive execution splits where a hub has gathered: a root with very many neighbours is not the key of any group. Each
round is written to the shared folder, which cuts the lineage, and the round before is dropped. Only two counts a
round come to the driver. It ends when the edges are stars: no vertex has two edges upwards, and no root has any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearspark.llm.common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """v, m: the smallest neighbour below each vertex that has one.

    Dealt by another expression than it is joined by, so the join shuffles it by itself and can split where it is skewed.
    """
    return edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).repartition(F.xxhash64("v"))


def _large(edges: DataFrame) -> DataFrame:
    met = edges.join(_least(edges), F.col("b") == F.col("v"), "left")
    return met.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    met = edges.join(_least(edges), F.col("a") == F.col("v"))
    moved = met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.*").where("a > b").distinct()


def _unsettled(edges: DataFrame) -> int:
    """Vertices that hang under two others, or under one while another hangs under them."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").count()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges a, b (any order, loops ignored) -> vertex, root: the smallest vertex it is connected with.

    Only vertices of edges are returned. No edge gives an empty table; an edge with a null end is no edge.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, k = scratch.write(ordered, f"{name}0"), 0
    while _unsettled(now):
        k += 1
        half = scratch.write(_large(now), f"{name}{k}l")
        now = scratch.write(_small(half), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}", f"{name}{k}l")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    )
