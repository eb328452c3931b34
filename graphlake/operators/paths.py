"""Walk enumeration forwards and backwards, cycles through a vertex, longest paths, path rows."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph
from graphlake.operators.traversal import ids_frame
from graphlake.storage import Rounds

def index_of(array: Column, element: Column) -> Column:
    """1-based place of an element, 0 if absent, null for null input."""
    return F.array_position(array, element)


def walks_from(graph: PropertyGraph, sources: Any, max_loops: int, attr: str | None = None, max_discovered: int | None = None) -> DataFrame:
    """(path[, attrs]): the walks from each source to a leaf, or of ``max_loops`` edges if cut there.

    There is no check for cycles; a source without out-edges gives the walk of
    one vertex. ``attrs`` holds the attribute of each edge. All walks are
    returned unless a caller sets ``max_discovered``, 1,000,000 in the
    reference: once so many walks, sources included, have grown, the next round
    does not start, the walks end where they are and a warning is given.
    """
    spark = graph.edges.sparkSession
    store = Rounds(spark, "walks")
    extra = [attr] if attr else []
    links = graph.links(*extra)
    state = ids_frame(graph, sources).select(F.array("id").alias("path"), F.col("id").alias("tail"))
    if attr:
        state = state.withColumn("attrs", F.array().cast(f"array<{links.schema[attr].dataType.simpleString()}>"))
    growing, seen = store.write(state, n=F.count(F.lit(1)))
    done: list[DataFrame] = []
    found, loop = seen["n"], 0
    keep = ["path", *(["attrs"] if attr else [])]
    while seen["n"] and loop < max_loops:
        if max_discovered is not None and found >= max_discovered:
            warnings.warn(f"{found} walks reach max_discovered={max_discovered}: {seen['n']} of them are cut after {loop} edges", stacklevel=2)
            break
        loop += 1
        tails = links.withColumnRenamed("src_id", "tail")
        # one join a round: walks that find no edge are leaves and stay as they are
        joined = growing.join(tails, "tail", "left")
        leaf = F.col("dst_id").isNull()
        step = joined.select(F.when(leaf, F.col("path")).otherwise(F.concat("path", F.array("dst_id"))).alias("path"), F.col("dst_id").alias("tail"), *([F.when(leaf, F.col("attrs")).otherwise(F.concat("attrs", F.array(attr))).alias("attrs")] if attr else []))
        out, seen = store.write(step, n=F.count("tail"))
        done.append(out.filter("tail is null").select(*keep))
        growing = out.filter("tail is not null")
        found += seen["n"]
    result = growing.select(*keep)
    for d in done:
        result = result.unionByName(d)
    return result


def path_edges(paths: DataFrame, attr: str | None = None) -> DataFrame:
    """(pathid, edge_idx, src_id, dst_id[, attr]): paths as one row per edge, numbered by the order of the paths.

    The edges of a path are its consecutive vertices; a path of one vertex has
    none. Numbering needs one total order, so ``pathid`` comes from a range
    sort and per-partition offsets, not from a single window.
    """
    keep = ["path", *(["attrs"] if attr else [])]
    numbered = with_row_ids(paths.select(*keep), ["path"], "pathid")
    return _edge_rows(numbered, attr, ["pathid"])


def path_edge_rows(paths: DataFrame, attr: str | None = None) -> DataFrame:
    """As ``path_edges`` with the path as text (ids joined by '-') in place of a number."""
    named = paths.withColumn("path_text", F.array_join(F.transform("path", lambda x: x.cast("string")), "-"))
    return _edge_rows(named, attr, ["path_text"])


def _edge_rows(paths: DataFrame, attr: str | None, keys: list[str]) -> DataFrame:
    n = F.size("path") - 1
    cols = [F.slice("path", F.lit(1), F.greatest(n, F.lit(0))).alias("s"), F.slice("path", F.lit(2), F.greatest(n, F.lit(0))).alias("d")]
    if attr:
        cols.append(F.col("attrs").alias("a"))
    rows = paths.filter(F.size("path") > 1).select(*keys, F.posexplode(F.arrays_zip(*cols)).alias("edge_idx", "e"))
    out = [*keys, "edge_idx", F.col("e.s").alias("src_id"), F.col("e.d").alias("dst_id")]
    return rows.select(*out, *([F.col("e.a").alias("attr")] if attr else []))


def with_row_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in the given order, by a distributed sort and offsets of its partitions."""
    store = Rounds(df.sparkSession, "row-ids")
    parts, _ = store.write(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition, so one window over all of them is small
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + within).cast("bigint")).drop("_part", "_start")


def paths_from(graph: PropertyGraph, sources: Any, max_loops: int, attr: str | None = None, **limits: int) -> DataFrame:
    """Edges of ``walks_from`` as (pathid, edge_idx, src_id, dst_id[, attr])."""
    return path_edges(walks_from(graph, sources, max_loops, attr, **limits), attr)


def backtrack(graph: PropertyGraph, sources: Any, max_loops: int, attr: str | None = None, **limits: int) -> DataFrame:
    """``paths_from`` against the edges; rows stand in walking order, opposite to the stored edges."""
    return paths_from(graph.reversed(), sources, max_loops, attr, **limits)


def cycles_from(graph: PropertyGraph, source: Any, candidates: DataFrame | None = None, max_length: int | None = None) -> DataFrame:
    """(path): simple cycles through ``source``, closed (first = last), over vertices of ``candidates`` (id) only."""
    store = Rounds(graph.edges.sparkSession, "cycles-from")
    links = graph.links()
    if candidates is not None:
        links = links.join(candidates.select(F.col("id").alias("dst_id")).distinct(), "dst_id", "left_semi").select("src_id", "dst_id")
    start = F.lit(source)
    grown, seen = store.write(links.filter(F.col("src_id") == start).select(F.array("src_id", "dst_id").alias("path"), F.col("dst_id").alias("tail")), n=F.count(F.lit(1)))
    parts, length = [grown], 1
    while seen["n"] and (max_length is None or length < max_length):
        length += 1
        step = parts[-1].filter(F.col("tail") != start).join(links, F.col("tail") == F.col("src_id")).filter(F.array_position("path", F.col("dst_id")) <= 1)
        grown, seen = store.write(step.select(F.concat("path", F.array("dst_id")).alias("path"), F.col("dst_id").alias("tail")), n=F.count(F.lit(1)))
        parts.append(grown)
    out = None
    for p in parts:
        closed = p.filter(F.col("tail") == start).select("path")
        out = closed if out is None else out.unionByName(closed)
    return out


def _roots(graph: PropertyGraph) -> DataFrame:
    links = graph.links()
    return links.select(F.col("src_id").alias("id")).distinct().join(links.select(F.col("dst_id").alias("id")), "id", "left_anti")


def longest_paths(graph: PropertyGraph, max_length: int = 10_000) -> DataFrame:
    """(path, length): all longest paths from vertices without in-edges, ids joined by '-->'; length in edges.

    Longest lengths are found first, one row per vertex; only edges on a
    longest path are walked back. A cycle below a root has no longest path and
    raises.
    """
    return _longest(graph, None, max_length).select("path", F.col("total").cast("bigint").alias("length"))


def longest_weighted_path(graph: PropertyGraph, weight: str, max_length: int = 10_000) -> DataFrame:
    """(path, weight): paths of the greatest total weight from vertices without in-edges, prefixes included.

    A path does not grow over an edge of null weight.
    """
    return _longest(graph, weight, max_length).select("path", F.col("total").alias("weight"))


def _longest(graph: PropertyGraph, weight: str | None, max_length: int) -> DataFrame:
    store = Rounds(graph.edges.sparkSession, "longest")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    links = graph.edges.select("src_id", "dst_id", w.alias("w")).filter(F.col("w").isNotNull())
    # best total at a vertex by number of edges: a vertex comes again with each length at which it is reached
    front, seen = store.write(_roots(graph).select("id", F.lit(0.0).alias("total"), F.lit(0).alias("step")), n=F.count(F.lit(1)))
    levels = [front]
    while seen["n"]:
        if len(levels) > max_length:
            raise ValueError("paths still grow: the graph has a cycle below a root")
        step = len(levels)
        nxt = links.join(levels[-1].select(F.col("id").alias("src_id"), "total"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.max(F.col("total") + F.col("w")).alias("total")).withColumn("step", F.lit(step))
        front, seen = store.write(nxt, n=F.count(F.lit(1)))
        if seen["n"]:
            levels.append(front)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    best = every.filter("step > 0").agg(F.max("total").alias("best")).first()["best"]
    spark = graph.edges.sparkSession
    if best is None:
        return spark.createDataFrame([], "path string, total double")
    ends = every.filter((F.col("total") == F.lit(best)) & (F.col("step") > 0))
    text = lambda c: F.col(c).cast("string")
    out = None
    walk = ends.select("id", "total", "step", text("id").alias("path"))
    for step in range(len(levels) - 1, 0, -1):
        here = walk.filter(F.col("step") == step)
        up = here.join(links, F.col("id") == F.col("dst_id")).join(levels[step - 1].select(F.col("id").alias("src_id"), F.col("total").alias("before")), "src_id").filter(F.col("before") + F.col("w") == F.col("total"))
        walk = walk.filter(F.col("step") < step).unionByName(up.select(F.col("src_id").alias("id"), F.col("before").alias("total"), (F.col("step") - 1).alias("step"), F.concat_ws("-->", text("src_id"), F.col("path")).alias("path")))
    out = walk.select("path", F.lit(best).alias("total"))
    return out
