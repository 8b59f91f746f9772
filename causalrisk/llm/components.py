"""Connected components of a graph of any size, by alternating stars over stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from causalrisk.llm.common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Per node u of directed edges (u, v): the least of u and its v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether directed edges (u, v) are stars: every u has one v, and no v is a u."""
    nothing = F.lit(None).cast("long")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("low"), F.col("v").alias("high"), F.lit(0).alias("named"))
    ends = ends.union(edges.select("v", nothing, nothing, F.lit(1)))
    nodes = ends.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("named").alias("named"))
    return not nodes.agg(F.count_if((F.col("low") < F.col("high")) | ((F.col("named") == 1) & F.col("low").isNotNull()))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component` (its least node) of every node that has an edge; edges: `a`, `b`, in any direction and number.

    A round links each node's larger neighbours to its least neighbour (large
    star), then its smaller ones (small star). Minima are partial aggregates;
    the neighbours of a hot node are rows of a join that adaptive execution can
    split. Both halves of a round are written, so that a plan never holds more
    than one, and only a number reaches the driver, until all edges are stars.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.union(now.select("v", "u"))
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "large_star")
        small = large.join(_lowest(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = stored(small, "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
