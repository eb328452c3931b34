"""Triangles of the simple undirected graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph


def intersection_count(a: Column, b: Column) -> Column:
    """Number of different elements two arrays share."""
    return F.size(F.array_intersect(a, b))


def triangle_count(graph: PropertyGraph) -> DataFrame:
    """(id, attr): triangles through each vertex; vertices in none are absent.

    Each pair is directed from the end of lower degree to the other, ties by
    id. Then no vertex has more than sqrt(2 * edges) out-neighbours, so a hub
    does not multiply wedges, and each triangle is found once.
    """
    pairs = graph.simple_pairs()
    deg = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(deg.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(deg.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    up = F.struct("na", "a") < F.struct("nb", "b")
    one = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = one.select("u", F.col("v").alias("x")).join(one.select("u", F.col("v").alias("y")), "u").filter("x <> y")
    closed = wedges.join(one.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"])
    return closed.select(F.explode(F.array("u", "x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("attr"))


def triangle_count_by_intersection(graph: PropertyGraph) -> DataFrame:
    """``triangle_count`` by intersecting the neighbour sets of the ends of each pair.

    Out-neighbours in degree order keep the sets small, as above.
    """
    pairs = graph.simple_pairs()
    deg = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(deg.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(deg.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    up = F.struct("na", "a") < F.struct("nb", "b")
    one = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    sets = one.groupBy("u").agg(F.collect_set("v").alias("s"))
    both = one.join(sets, "u").join(sets.select(F.col("u").alias("v"), F.col("s").alias("s2")), "v")
    third = both.select("u", "v", F.array_intersect("s", "s2").alias("w")).filter(F.size("w") > 0)
    return third.select(F.explode(F.concat(F.flatten(F.transform("w", lambda x: F.array(F.col("u"), F.col("v"), x))))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("attr"))
