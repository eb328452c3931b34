"""Layers of acyclic graphs, cycle cores and cycle enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph
from graphlake.operators.traversal import FOLD_EVERY, _Found, _union
from graphlake.storage import Rounds


def topo_sorting(graph: PropertyGraph, max_loop: int = 10_000) -> DataFrame:
    """(id, attr): 1 plus the longest walk that leads to the vertex.

    Vertices are settled in waves: a wave holds the vertices all of whose
    in-edges come from settled ones, so each edge is used once. If a wave is
    empty before all vertices are settled, the graph has a cycle and the call
    raises; so it does if more than ``max_loop`` waves are needed.
    """
    settled, left = _peel(graph, max_loop)
    if left:
        raise ValueError(f"{left} vertices lie on or below a cycle, or more than {max_loop} layers are needed")
    return settled.select("id", F.col("wave").alias("attr"))


def _peel(graph: PropertyGraph, max_loop: int) -> tuple[DataFrame, int]:
    """((id, wave) of the vertices that no cycle leads to, number of the others).

    A wave writes only the vertices that it meets, with the in-edges it has
    used up; what a vertex needs is written once. The parts of a vertex that is
    met in several waves are added up when they are folded.
    """
    store = Rounds(graph.edges.sparkSession, "peel")
    links, _ = store.write(graph.links().groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("k")))
    need = links.groupBy(F.col("dst_id").alias("id")).agg(F.sum("k").alias("need"))
    need, seen = store.write(graph.vertex_ids().join(need, "id", "left").select("id", F.coalesce("need", F.lit(0)).alias("need")), n=F.count(F.lit(1)))
    total, wave = seen["n"], 1
    front, seen = store.write(need.filter("need = 0").select("id", F.lit(1).alias("wave")), n=F.count(F.lit(1)))
    found, done = _Found(store), seen["n"]
    found.add(front)
    recent: list[DataFrame] = []  # (id, got, wave), wave where the vertex is settled
    parts: DataFrame | None = None  # (id, got) of unsettled vertices met before those
    while seen["n"] and done < total and wave < max_loop:
        wave += 1
        met = links.join(front.select(F.col("id").alias("src_id")), "src_id", "left_semi").groupBy(F.col("dst_id").alias("id")).agg(F.sum("k").alias("got"))
        before = [p for p in [parts, *(r.filter("wave is null").select("id", "got") for r in recent)] if p is not None]
        whole = met.select("id", F.col("got").alias("now"), "got")
        if before:
            earlier = _union(before).join(met.select("id"), "id", "left_semi").select("id", F.lit(0).cast("bigint").alias("now"), "got")
            whole = whole.unionAll(earlier).groupBy("id").agg(F.sum("now").alias("now"), F.sum("got").alias("got"))
        written, seen = store.write(whole.join(need, "id").select("id", F.col("now").alias("got"), F.when(F.col("got") == F.col("need"), F.lit(wave)).alias("wave")), n=F.count(F.col("wave")))
        recent.append(written)
        front = written.filter("wave is not null").select("id", "wave")
        done += seen["n"]
        if len(recent) >= FOLD_EVERY:
            settled, _ = store.write(_union([r.filter("wave is not null").select("id", "wave") for r in recent]))
            left = _union([p for p in [parts, *(r.filter("wave is null").select("id", "got") for r in recent)] if p is not None])
            left = left.groupBy("id").agg(F.sum("got").alias("got")).join(settled.select("id"), "id", "left_anti")
            folded, _ = store.write(left)
            found.add(settled)
            front, _ = store.write(front)
            store.drop(*recent, parts)
            parts, recent = folded, []
    return _union([found.all(), *(r.filter("wave is not null").select("id", "wave") for r in recent)]), total - done


def cycle_detect_in(graph: PropertyGraph, max_loop: int = 100_000) -> DataFrame:
    """(id) of the vertices left when vertices without in-edges are removed again and again."""
    settled, _ = _peel(graph, max_loop)
    return graph.vertex_ids().join(settled.select("id"), "id", "left_anti")


def cycle_detect_out(graph: PropertyGraph, max_loop: int = 100_000) -> DataFrame:
    """(id) of the vertices left when vertices without out-edges are removed again and again."""
    return cycle_detect_in(graph.reversed(), max_loop)


def cycle_core(graph: PropertyGraph) -> DataFrame:
    """(id) left by both removals: all vertices on cycles, and those between two cycles."""
    return cycle_detect_in(graph).join(cycle_detect_out(graph), "id", "left_semi")


def cycles(graph: PropertyGraph, max_length: int = -1, num_limit: int = -1, edge_type: str | None = None) -> DataFrame:
    """(path[, edges_type]): all simple cycles of at most ``max_length`` edges, closed, from their smallest vertex, once each.

    Negative bounds mean none. ``num_limit`` keeps the first cycles by length
    and path. Paths only grow from the smallest vertex of their cycle, so no
    rotation is found twice, and only inside the cycle core.
    """
    store = Rounds(graph.edges.sparkSession, "cycles")
    core, _ = store.write(cycle_core(graph))
    extra = [edge_type] if edge_type else []
    links = graph.links(*extra).distinct()
    links = links.join(core.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(core.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id", *extra)
    types = [F.array(edge_type).alias("edges_type")] if edge_type else []
    grown, seen = store.write(links.filter("dst_id >= src_id").select(F.array("src_id", "dst_id").alias("path"), F.col("src_id").alias("head"), F.col("dst_id").alias("tail"), *types), n=F.count_if(F.col("tail") != F.col("head")))
    parts, length = [grown], 1
    while seen["n"] and (max_length < 0 or length < max_length):
        length += 1
        step = parts[-1].filter("tail <> head").join(links, F.col("tail") == F.col("src_id")).filter((F.col("dst_id") >= F.col("head")) & (F.array_position("path", F.col("dst_id")) <= 1))
        more = [F.concat("edges_type", F.array(edge_type)).alias("edges_type")] if edge_type else []
        grown, seen = store.write(step.select(F.concat("path", F.array("dst_id")).alias("path"), "head", F.col("dst_id").alias("tail"), *more), n=F.count_if(F.col("tail") != F.col("head")))
        parts.append(grown)
    keep = ["path", *(["edges_type"] if edge_type else [])]
    out = None
    for p in parts:
        closed = p.filter("tail = head").select(*keep)
        out = closed if out is None else out.unionByName(closed)
    return out.orderBy(F.size("path"), *keep).limit(num_limit) if num_limit >= 0 else out
