"""Shortest paths by edges and by weight.

Both first settle how far each vertex is, one row per vertex and level, and
only then walk back over the edges that lie on a shortest path. Enumerating
partial paths on the way out, which grows without bound, is not needed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph
from graphlake.operators.traversal import ids_frame, reachable
from graphlake.storage import Rounds


def shortest_path(graph: PropertyGraph, source: Any, target: Any, max_length: int, edge_type: str | None = None) -> DataFrame:
    """(path[, edges_type]): all shortest paths of at most ``max_length`` edges.

    ``edge_type`` names an edge column whose values along the path are given
    as a second array; parallel edges of different types are different paths.
    From a vertex to itself the path is that vertex. Nothing is given if the
    target cannot be reached.

    The search runs from both ends, a level from either side in turn, and
    stops when they meet; it visits about the square root of what a search
    from one end would.
    """
    spark = graph.edges.sparkSession
    store = Rounds(spark, "shortest")
    links = graph.links(*([edge_type] if edge_type else []))
    pairs = graph.links()
    kind = dict(links.dtypes)["src_id"]
    a, b = ids_frame(graph, source), ids_frame(graph, target)
    arr = f"array<{dict(links.dtypes)[edge_type]}>" if edge_type else None
    if source == target:
        one = a.select(F.array("id").alias("path"))
        return one.withColumn("edges_type", F.array().cast(arr)) if edge_type else one
    sides = []
    for ids, (s, d) in ((a, ("src_id", "dst_id")), (b, ("dst_id", "src_id"))):
        first, _ = store.write(ids.select("id", F.lit(0).alias("hop")))
        sides.append({"s": s, "d": d, "front": first, "seen": [first], "hop": 0})
    length = 0
    met = False
    while not met and length < max_length:
        side, other = (sides[0], sides[1]) if length % 2 == 0 else (sides[1], sides[0])
        side["hop"] += 1
        length += 1
        known = _union(side["seen"]).select("id")
        step = pairs.join(side["front"].select(F.col("id").alias(side["s"])), side["s"], "left_semi").select(F.col(side["d"]).alias("id")).distinct().join(known, "id", "left_anti").select("id", F.lit(side["hop"]).alias("hop"))
        # whether the other side knows a vertex is seen while the frontier is written
        flagged = step.join(_union(other["seen"]).select("id", F.lit(1).alias("hit")), "id", "left")
        front, seen = store.write(flagged, n=F.count(F.lit(1)), hits=F.count("hit"))
        side["front"] = front.select("id", "hop")
        side["seen"].append(side["front"])
        met = seen["hits"] > 0
        if not seen["n"]:
            break
    if not met:
        empty = spark.createDataFrame([], f"path array<{kind}>" + (f", edges_type {arr}" if edge_type else ""))
        return empty
    # vertices that lie on some path of this length: known to both sides, hops adding up to it
    last = sides[1]["hop"]
    middle = sides[0]["front"].join(_union(sides[1]["seen"]).filter(F.col("hop") == last).select("id"), "id", "left_semi")
    middle = middle.select("id")
    halves = []
    for side in sides:
        half = middle.select(F.col("id").alias("m"), "id", F.array("id").alias("path"), *([F.array().cast(arr).alias("types")] if edge_type else []))
        for hop in range(side["hop"] - 1, -1, -1):
            back = _union(side["seen"]).filter(F.col("hop") == hop).select(F.col("id").alias(side["s"]))
            e = links.join(back, side["s"], "left_semi")
            if not edge_type:
                e = e.distinct()
            else:
                e = e.select("src_id", "dst_id", edge_type).distinct()
            out = side["s"] == "src_id"
            grown = half.join(e, F.col("id") == F.col(side["d"]))
            path = F.concat(F.array(side["s"]), F.col("path")) if out else F.concat(F.col("path"), F.array(side["s"]))
            cols = ["m", F.col(side["s"]).alias("id"), path.alias("path")]
            if edge_type:
                cols.append((F.concat(F.array(edge_type), F.col("types")) if out else F.concat(F.col("types"), F.array(edge_type))).alias("types"))
            half = grown.select(*cols)
        halves.append(half)
    left, right = halves[0].alias("l"), halves[1].alias("r")
    both = left.join(right, F.col("l.m") == F.col("r.m"))
    cols = [F.concat("l.path", F.slice("r.path", F.lit(2), F.size("r.path"))).alias("path")]
    if edge_type:
        cols.append(F.concat("l.types", "r.types").alias("edges_type"))
    return both.select(*cols)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distances(graph: PropertyGraph, source: Any, max_length: int | None = None) -> DataFrame:
    """(id, hop): fewest edges from the source to every vertex it reaches."""
    return reachable(graph, source, max_length)


def shortest_weighted_path(graph: PropertyGraph, source: Any, target: Any, max_length: int, weight: str, tolerance: float = 1e-9) -> DataFrame:
    """(path, weights, total): all paths of the least total weight with at most ``max_length`` edges.

    A path never comes back to its source and ends when it meets its target.
    Edges without weight are not walked. Nothing is given if there is no path.
    State is the least weight by vertex and number of edges, so weights may be
    negative and walks never multiply.
    """
    spark = graph.edges.sparkSession
    store = Rounds(spark, "weighted")
    kind = dict(graph.edges.dtypes)["src_id"]
    s, t = F.lit(source), F.lit(target)
    links = graph.edges.select("src_id", "dst_id", F.col(weight).cast("double").alias("w")).filter(F.col("w").isNotNull() & (F.col("dst_id") != s) & (F.col("src_id") != t))
    # of parallel edges the cheapest is on a path; equal ones are one path
    links = links.groupBy("src_id", "dst_id").agg(F.min("w").alias("w"))
    front, seen = store.write(ids_frame(graph, source).select("id", F.lit(0.0).alias("d")), n=F.count(F.lit(1)))
    levels, best = [front], None
    for _ in range(max_length):
        step = links.join(levels[-1].select(F.col("id").alias("src_id"), "d"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        front, seen = store.write(step, n=F.count(F.lit(1)), best=F.min(F.when(F.col("id") == t, F.col("d"))))
        if not seen["n"]:
            break
        levels.append(front)
        if seen["best"] is not None and (best is None or seen["best"] < best):
            best = seen["best"]
    if best is None:
        return spark.createDataFrame([], f"path array<{kind}>, weights array<double>, total double")
    near = lambda a, b: F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(b), F.lit(1.0))
    out = None
    for last in range(1, len(levels)):
        walk = levels[last].filter((F.col("id") == t) & near(F.col("d"), F.lit(best))).select("id", "d", F.array("id").alias("path"), F.array().cast("array<double>").alias("weights"))
        for step in range(last - 1, -1, -1):
            back = levels[step].select(F.col("id").alias("src_id"), F.col("d").alias("before"))
            walk = walk.join(links, F.col("id") == F.col("dst_id")).join(back, "src_id").filter(near(F.col("before") + F.col("w"), F.col("d"))).select(F.col("src_id").alias("id"), F.col("before").alias("d"), F.concat(F.array("src_id"), F.col("path")).alias("path"), F.concat(F.array("w"), F.col("weights")).alias("weights"))
        found = walk.select("path", "weights", F.lit(best).alias("total"))
        out = found if out is None else out.unionByName(found)
    return out
