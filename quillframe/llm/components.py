"""Connected components of a graph too large for one machine, with DataFrame operations only.

Alternating large-star and small-star steps: each links a node's neighbours to the least node it knows, so the
graph turns into stars in a logarithmic number of rounds while the number of edges does not grow. Each round is cut
off from its lineage by a reliable checkpoint. Least neighbours are pre-aggregated, and the joins that spread them
are plain equi-joins, which adaptive execution splits where a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import checkpointed, discard

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """edges (u > v): each larger neighbour of u goes to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """edges (u > v): u and its smaller neighbours go to the least of them."""
    least = _least(edges)
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (a, b) of longs in either direction; gives node, label (the least node of its component).

    Nodes without a link are not in the result; loops, repeated links and nulls are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(spark, edges)
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).alias("mark")
    last = edges.agg(mark).first()[0]
    for _ in range(MAX_ROUNDS):
        if last[0] == 0:
            break
        before, edges = edges, checkpointed(spark, small_star(large_star(edges)))
        discard(before)
        now = edges.agg(mark).first()[0]
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def cross_pairs(crowd: DataFrame, labels: DataFrame, allowed=None, marks: bool = False) -> DataFrame:
    """crowd (key, id, mark): the pairs (a, b) of a key that labels (node, label) do not connect; ``allowed`` is a condition on their marks ma and mb.

    With the links that gave the labels, testing these is testing every pair of each key: the others are connected.
    With ``marks`` the pairs keep their marks.
    """
    named = crowd.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "mark", F.coalesce("label", "id").alias("label"))
    groups = named.select("key", "label").distinct()
    other = groups.select("key", F.col("label").alias("lb")).join(groups.select("key", F.col("label").alias("la")), "key").filter("la < lb")
    one = named.select("key", F.col("label").alias("la"), F.col("id").alias("x"), F.col("mark").alias("ma"))
    two = named.select("key", F.col("label").alias("lb"), F.col("id").alias("y"), F.col("mark").alias("mb"))
    both = other.join(one, ["key", "la"]).join(two, ["key", "lb"])
    if allowed is not None:
        both = both.filter(allowed)
    out = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *["ma", "mb"] * marks)
    return out if marks else out.distinct()
