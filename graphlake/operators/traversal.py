"""Reachability, breadth-first edges, neighbourhoods and walk counts.

Frontier loops write each frontier and never the whole state: a round joins
the edges with the vertices found in the round before, and an anti-join keeps
out what was found earlier. What was found is the union of the written
frontiers, folded into one table now and then so that plans stay short.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph
from graphlake.storage import Rounds

#: Written frontiers that are read side by side before they are folded into one table.
FOLD_EVERY = 12
#: Levels of a search that are planned together before what they found is written.
HOPS_PER_ROUND = 2


class _Found:
    """The written frontiers of a loop. Folded tables are folded again when there are many, so a row is rewritten seldom."""

    def __init__(self, store: Rounds):
        self.store = store
        self.folds: list[list[DataFrame]] = [[]]

    def add(self, part: DataFrame, fold: int = 0) -> None:
        if fold == len(self.folds):
            self.folds.append([])
        self.folds[fold].append(part)
        if len(self.folds[fold]) > FOLD_EVERY:
            parts, self.folds[fold] = self.folds[fold], []
            whole, _ = self.store.write(_union(parts))
            self.store.drop(*parts)
            self.add(whole, fold + 1)

    def all(self) -> DataFrame:
        return _union([p for parts in reversed(self.folds) for p in parts])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ids_frame(graph: PropertyGraph, ids: Any) -> DataFrame:
    """(id) from a DataFrame with a column id, a list of ids or a single id."""
    if isinstance(ids, DataFrame):
        return ids.select("id").filter(F.col("id").isNotNull()).distinct()
    values = list(ids) if isinstance(ids, (list, tuple, set)) else [ids]
    kind = graph.edges.schema["src_id"].dataType
    return graph.edges.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "id string").select(F.col("id").cast(kind)) if isinstance(values[0], str) else graph.edges.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "id bigint").select(F.col("id").cast(kind))


def reachable(graph: PropertyGraph, sources: Any, max_hops: int | None = None) -> DataFrame:
    """(id, hop): every vertex that walks from the sources reach, with the fewest edges to it; sources have hop 0."""
    return _levels(graph.links(), ids_frame(graph, sources), max_hops, "reach")


def _expand(links: DataFrame, frontier: DataFrame, found: DataFrame, hop: int) -> DataFrame:
    """(id, hop) of the vertices one edge away from the frontier that are not found."""
    step = links.join(frontier.select(F.col("id").alias("src_id")), "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct()
    return step.join(found.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"))


def _levels(links: DataFrame, sources: DataFrame, max_hops: int | None, name: str) -> DataFrame:
    store = Rounds(links.sparkSession, name)
    found = _Found(store)
    frontier, seen = store.write(sources.select("id", F.lit(0).alias("hop")), n=F.count(F.lit(1)))
    found.add(frontier)
    hop = 0
    while seen["n"] and (max_hops is None or hop < max_hops):
        # levels are planned HOPS_PER_ROUND at a time: the exchanges of a level are reused by the next
        known, near, out = found.all().select("id"), frontier, None
        for _ in range(HOPS_PER_ROUND if max_hops is None else min(HOPS_PER_ROUND, max_hops - hop)):
            hop += 1
            near = _expand(links, near, known, hop)
            out = near if out is None else out.unionByName(near)
            known = known.unionByName(near.select("id"))
        written, seen = store.write(out, n=F.count_if(F.col("hop") == hop))
        found.add(written)
        frontier = written.filter(F.col("hop") == hop)
    return found.all()


def bfs_from(graph: PropertyGraph, source: Any, distinct: bool = True) -> DataFrame:
    """(src_id, dst_id, attr): the edges by which a breadth-first search meets each vertex; attr is the level.

    Level 0 holds all out-edges of the source, self-loops included; further
    levels the edges from the level before to vertices met by none yet, one
    for each parent. ``distinct=False`` keeps parallel edges of level 0.

    The search only carries vertices and levels; the edges come from one join
    at the end, between vertices one level apart.
    """
    links = graph.links()
    levels = reachable(graph, source)
    first = links.join(F.broadcast(ids_frame(graph, source).select(F.col("id").alias("src_id"))), "src_id", "left_semi").select("src_id", "dst_id", F.lit(0).alias("attr"))
    at = levels.filter("hop > 0")
    further = (
        links.join(at.select(F.col("id").alias("src_id"), F.col("hop").alias("hs")), "src_id")
        .join(at.select(F.col("id").alias("dst_id"), F.col("hop").alias("hd")), "dst_id")
        .filter(F.col("hd") == F.col("hs") + 1)
        .select("src_id", "dst_id", F.col("hs").alias("attr"))
        .distinct()
    )
    return (first.distinct() if distinct else first).unionByName(further)


def neighbours(graph: PropertyGraph, vertex: Any, k_hop: int, edges: bool = False) -> DataFrame:
    """Vertices within ``k_hop`` edges of any direction as (id, attr), attr the fewest hops; or the edges met as (src_id, dst_id).

    Edges come in their own direction and once for each time they are met:
    all of the vertex itself, then the distinct ones to vertices not met yet.
    """
    both = PropertyGraph(graph.undirected())
    levels = reachable(both, vertex, k_hop)
    if not edges:
        return levels.select("id", F.col("hop").alias("attr"))
    start = ids_frame(graph, vertex).select(F.col("id").alias("src_id"))
    ways = graph.links().select("src_id", "dst_id", F.lit(1).alias("d")).unionByName(graph.reversed().links().select("src_id", "dst_id", F.lit(-1).alias("d")))
    first = ways.join(F.broadcast(start), "src_id", "left_semi").select("src_id", "dst_id", "d")
    at = levels.filter("hop > 0")
    further = (
        ways.join(at.select(F.col("id").alias("src_id"), F.col("hop").alias("hs")), "src_id")
        .join(at.select(F.col("id").alias("dst_id"), F.col("hop").alias("hd")), "dst_id")
        .filter(F.col("hd") == F.col("hs") + 1)
        .select("src_id", "dst_id", "d")
        .distinct()
    )
    met = first.unionByName(further) if k_hop > 1 else first
    flip = lambda a, b: F.when(F.col("d") == 1, F.col(a)).otherwise(F.col(b))
    return met.select(flip("src_id", "dst_id").alias("src_id"), flip("dst_id", "src_id").alias("dst_id"))


def out_walk_count(graph: PropertyGraph, k_hop: int) -> DataFrame:
    """(id, attr): most walks of one length of at most ``k_hop`` edges that leave the vertex.

    A fixed number of joins of folded counts, so one lazy plan.
    """
    walks = graph.links().groupBy(F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    every = walks
    for _ in range(k_hop - 1):
        walks = graph.links().join(walks.select(F.col("id").alias("dst_id"), "n"), "dst_id").groupBy(F.col("src_id").alias("id")).agg(F.sum("n").alias("n"))
        every = every.unionByName(walks)
    return every.groupBy("id").agg(F.max("n").alias("attr"))


def in_walk_count(graph: PropertyGraph, k_hop: int) -> DataFrame:
    """``out_walk_count`` of the reversed graph."""
    return out_walk_count(graph.reversed(), k_hop)


def walk_count(graph: PropertyGraph, k_hop: int) -> DataFrame:
    """(id, attr): the sum of ``out_walk_count`` and ``in_walk_count``."""
    out, into = out_walk_count(graph, k_hop), in_walk_count(graph, k_hop)
    both = out.unionByName(into)  # each side has an id once, so a sum is the full join
    return both.groupBy("id").agg(F.sum("attr").alias("attr"))


def k_hop_distinct_count(graph: PropertyGraph, k_hop: int) -> DataFrame:
    """(id, attr): different vertices reached by walks of 1 to ``k_hop`` edges."""
    pairs = graph.links().distinct()
    every = pairs
    for _ in range(k_hop - 1):
        pairs = pairs.alias("p").join(graph.links().distinct().alias("e"), F.col("p.dst_id") == F.col("e.src_id")).select("p.src_id", "e.dst_id").distinct()
        every = every.unionByName(pairs).distinct()
    return every.groupBy(F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("attr"))


def strongly_connected_component(graph: PropertyGraph, vertex: Any) -> DataFrame:
    """(id) of the strongly connected component of a vertex: reached from it and reaching it."""
    return reachable(graph, vertex).select("id").join(reachable(graph.reversed(), vertex).select("id"), "id", "left_semi")


def weakly_connected_component(graph: PropertyGraph, vertex: Any) -> DataFrame:
    """(id) of all vertices linked to a vertex in any direction."""
    return reachable(PropertyGraph(graph.undirected()), vertex).select("id")


