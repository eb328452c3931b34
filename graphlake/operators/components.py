"""Weakly connected components of a whole graph, by alternating stars.

Large star: each vertex sends its greater neighbours to its smallest one.
Small star: it sends its smaller neighbours there. Both keep components and
shrink trees towards stars; a chain of n vertices takes about log n rounds,
where passing labels along would take n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph
from graphlake.operators.skew import HOT_ROWS, join_to_keys
from graphlake.storage import Rounds


def weakly_connected_components(graph: PropertyGraph, max_rounds: int = 100) -> DataFrame:
    """(id, attr): attr is the smallest id of the component. Strings compare as text, numbers as numbers.

    Isolated vertices of the vertex table are their own component.
    """
    store = Rounds(graph.edges.sparkSession, "components")
    pairs, seen = store.write(graph.simple_pairs().select(F.col("b").alias("u"), F.col("a").alias("v")), **_state())
    for _ in range(max_rounds):
        nxt, now = store.write(_small_star(store, _large_star(store, pairs, seen["n"]), seen["n"]), **_state())
        store.drop(pairs)
        pairs = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    inner = pairs.select(F.col("u").alias("id"), F.col("v").alias("attr"))
    return graph.vertex_ids().join(inner, "id", "left").select("id", F.coalesce("attr", "id").alias("attr"))


def _state() -> dict:
    return {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v")), "s": F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))}


def _with_least(store: Rounds, rows: DataFrame, key: str, least: DataFrame, total: int) -> DataFrame:
    """Rows with the least of their key; hot keys are not shuffled by it."""
    if total > HOT_ROWS:
        least, _ = store.write(least)
    return join_to_keys(rows, least, key, total, "n").drop("n")


def _large_star(store: Rounds, pairs: DataFrame, total: int) -> DataFrame:
    """Pairs (u, v) with u > v in, the same out: greater neighbours go to the smallest."""
    pair = lambda a, b: F.struct(F.col(a).alias("c"), F.col(b).alias("o"))
    both = pairs.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("x")).select("x.c", "x.o")
    least = both.groupBy("c").agg(F.min("o").alias("m"), F.count(F.lit(1)).alias("n")).select("c", F.least("c", "m").alias("m"), "n")
    return _with_least(store, both, "c", least, 2 * total).filter("o > c").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(store: Rounds, pairs: DataFrame, total: int) -> DataFrame:
    """Smaller neighbours, and the vertex itself, go to the smallest."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(store, pairs, "u", least, total)
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
