"""Connected components by alternating large and small stars (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.llm.common import discard, written


def _is_done(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("out").alias("outs"), F.min("out").alias("in"))
    return not roles.filter("outs > 1 or (outs = 1 and in = 0)").limit(1).count()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are joined to its least neighbour or itself. Rows may repeat, no more than edges."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return down.unionByName(least.withColumnRenamed("low", "v")).filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) for every node that links (a, b) name, in O(log nodes) rounds, as a
    written table. Links in either direction, repeated links and links of a node to itself are allowed; nulls link
    nothing."""
    named = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = named.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "stars")
    while not _is_done(edges):
        before, edges = edges, written(_small_star(_large_star(edges)), "stars")
        discard(before)
    alone = named.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = written(alone.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")), "components")
    discard(edges)
    return found
