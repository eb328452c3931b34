"""Neighbour sampling, walks and typed receptive fields: the data side of graph learning.

Randomness is a hash of ids and a seed, so a lost task draws the same again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph
from graphlake.operators.metapath import parse_sample_path
from graphlake.operators.skew import running_totals
from graphlake.storage import Rounds


def uniform(*columns: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the hash of some columns and a seed."""
    bits = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52))
    return (bits + 0.5) / float(1 << 52)


def top_neighbours(graph: PropertyGraph, k: int, weight: str | None = None, ties: Sequence[str] = ("dst_id",)) -> DataFrame:
    """Edges of each source with its ``k`` heaviest ones and their rank; all edges of a source with fewer.

    The rank is taken over pre-cut edges: a window limit keeps k rows a source
    in each task before the shuffle, so hubs do not gather in one task.
    """
    order = [*([F.desc(weight)] if weight else []), *ties]
    rank = F.row_number().over(Window.partitionBy("src_id").orderBy(*order))
    return graph.edges.withColumn("rank", rank).filter(F.col("rank") <= k)


def random_neighbours(graph: PropertyGraph, k: int, seed: int, weight: str | None = None) -> DataFrame:
    """(src_id, dst_id, rank): up to ``k`` different edges of each source drawn without replacement.

    With a weight, edges come with probability in proportion to it: the
    smallest of -ln(u) / w win. Edges of weight 0 or less never come.
    """
    # without an id the whole row tells edges apart, so that a lost task draws the same again; equal rows are drawn together
    edges = graph.edges.withColumn("_n", F.xxhash64(*graph.edges.columns) if "eid" not in graph.edges.columns else F.col("eid"))
    u = uniform("src_id", "dst_id", "_n", seed=seed)
    key = u if weight is None else -F.ln(u) / F.col(weight)
    edges = edges if weight is None else edges.filter(F.col(weight) > 0)
    drawn = edges.select("src_id", "dst_id", key.alias("_key"))
    rank = F.row_number().over(Window.partitionBy("src_id").orderBy("_key", "dst_id"))
    return drawn.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_key")


def negative_samples(graph: PropertyGraph, per_source: int, seed: int, by_in_degree: bool = False) -> DataFrame:
    """(src_id, neg_id, i): vertices drawn for each source, evenly or in proportion to in-degree, edges left out.

    A draw is a place on the line of all vertices (or all edges); places are
    joined by number, and draws that hit an edge or the source are dropped.
    """
    from graphlake.operators.paths import with_row_ids

    line = graph.edges.select(F.col("dst_id").alias("neg_id"), *(["eid"] if "eid" in graph.edges.columns else [])) if by_in_degree else graph.vertex_ids().select(F.col("id").alias("neg_id"))
    places = with_row_ids(line, line.columns, "place").select("place", "neg_id")
    n = places.count()
    draws = graph.links().select("src_id").distinct().select("src_id", F.explode(F.sequence(F.lit(1), F.lit(per_source))).alias("i"))
    draws = draws.withColumn("place", (F.floor(uniform("src_id", "i", seed=seed) * n) + 1).cast("bigint"))
    got = draws.join(places, "place").filter("src_id <> neg_id").select("src_id", "neg_id", "i")
    return got.join(graph.links().select("src_id", F.col("dst_id").alias("neg_id")), ["src_id", "neg_id"], "left_anti")


def random_walks(graph: PropertyGraph, length: int, seed: int, weight: str | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(walk): a walk of up to ``length`` edges from each start, by default every vertex; it ends early at a leaf.

    Each edge owns a span of its source's line, which is cut into as many even
    boxes as the source has neighbours; a step draws a place on the line and
    joins the edges in its box by equality. An edge lies in few boxes, so
    neither a hub's line nor its walkers meet in one task or multiply.
    """
    store = Rounds(graph.edges.sparkSession, "walks")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e, seen = store.write(graph.edges.select("src_id", "dst_id", w.alias("w")).filter("w > 0").groupBy("src_id", "dst_id").agg(F.sum("w").alias("w")), n=F.count(F.lit(1)))
    runs, _ = store.write(running_totals(store, e, ["src_id", "dst_id"], {"at": F.col("w")}, seen["n"]))
    ends = runs.groupBy("src_id").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("w")).alias("last"), F.count(F.lit(1)).alias("deg"))
    ends, _ = store.write(ends)
    long = F.col("last") - F.col("first")
    spans = runs.join(ends, "src_id").select("src_id", "dst_id", "deg", ((F.col("at") - F.col("first")) / long).alias("lo"), ((F.col("at") + F.col("w") - F.col("first")) / long).alias("hi"))
    top = F.col("deg") - 1
    box = lambda x: F.least(F.floor(x * F.col("deg")), top)
    spans, _ = store.write(spans.select("src_id", "dst_id", "lo", "hi", F.explode(F.sequence(box(F.col("lo")), box(F.col("hi")))).alias("box")))
    degrees = ends.select(F.col("src_id").alias("tail"), "deg")
    ids = starts.select("id") if starts is not None else graph.vertex_ids()
    state = ids.select(F.col("id").alias("start"), F.array("id").alias("walk"), F.col("id").alias("tail"))
    for step in range(length):
        u = uniform("start", "tail", F.lit(step), seed=seed)
        drawn = state.join(degrees, "tail", "left").withColumn("u", u)
        there = drawn.withColumn("at_box", F.least(F.floor(F.col("u") * F.col("deg")), F.col("deg") - 1))
        met = (F.col("tail") == F.col("src_id")) & (F.col("at_box") == F.col("box")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
        grown = there.join(spans, met, "left")
        state = grown.select("start", F.when(F.col("dst_id").isNull(), F.col("walk")).otherwise(F.concat("walk", F.array("dst_id"))).alias("walk"), F.col("dst_id").alias("tail"))
    return state.select("walk")


def skipgram_pairs(walks: DataFrame, column: str, window: int) -> DataFrame:
    """(target, context): pairs of places of a walk that are at most ``window`` apart."""
    rows = walks.select(F.col(column).alias("_w"), F.posexplode(column).alias("i", "target"))
    before = F.slice("_w", F.greatest(F.col("i") - window + 1, F.lit(1)), F.least(F.col("i"), F.lit(window)))
    after = F.slice("_w", F.col("i") + 2, F.lit(window))
    return rows.select("target", F.explode(F.concat(before, after)).alias("context"))


def receptive_field(graph: PropertyGraph, path: str, vertex_type: str = "vtype", edge_type: str = "etype", k: int | None = None, weight: str | None = None) -> DataFrame:
    """(seed, hop1, hop2, ...): all vertices met along a typed sample path from each vertex of its first type.

    ``k`` keeps the k heaviest edges of each vertex a hop. The path has a
    fixed length, so this is one plan of joins.
    """
    first, steps = parse_sample_path(path)
    of = lambda t: graph.vertices.filter(F.col(vertex_type) == t).select("id").distinct()
    out = of(first).select(F.col("id").alias("seed"), F.col("id").alias("_tail"))
    for i, s in enumerate(steps, 1):
        g = graph.of_type(s.edge_type, edge_type)
        g = g if s.forward else g.reversed()
        if k is not None:
            g = PropertyGraph(top_neighbours(g, k, weight))
        ends = of(s.vertex_type).select(F.col("id").alias("dst_id"))
        step = g.links().join(ends, "dst_id", "left_semi").select(F.col("src_id").alias("_tail"), F.col("dst_id").alias("_next"))
        out = out.join(step, "_tail").select("seed", *(f"hop{j}" for j in range(1, i)), F.col("_next").alias(f"hop{i}"), F.col("_next").alias("_tail"))
    return out.drop("_tail")
