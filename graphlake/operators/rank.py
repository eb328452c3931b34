"""PageRank with a jump probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph
from graphlake.storage import Rounds

#: Iterations that are planned together before the ranks are written.
STEPS_PER_ROUND = 4


def pagerank(graph: PropertyGraph, beta: float = 0.15, delta_min: float | None = 1e-5, max_iter: int = 100) -> DataFrame:
    """(id, attr): rank after convergence, or after ``max_iter`` iterations if ``delta_min`` is None.

    All vertices start with 1/N. A vertex with in-edges gets
    (1 - beta) * sum(rank / out-degree of its predecessors) + beta / N; one
    without keeps 1/N; the rank of vertices without out-edges is lost. The
    loop ends when no rank moves by more than ``delta_min``.

    Parallel edges are folded into one with their number first, so a round is
    one join and one aggregation over folded edges.
    """
    spark = graph.edges.sparkSession
    store = Rounds(spark, "pagerank")
    links = graph.links().groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("k"))
    out = links.groupBy("src_id").agg(F.sum("k").alias("deg"))
    weighted, _ = store.write(links.join(out, "src_id").select("src_id", "dst_id", (F.col("k") / F.col("deg")).alias("part")))
    ids = graph.vertex_ids()
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("attr"))
    fed = weighted.select(F.col("dst_id").alias("id")).distinct().withColumn("fed", F.lit(True))
    nodes, _ = store.write(ids.join(fed, "id", "left").select("id", F.coalesce("fed", F.lit(False)).alias("fed")))
    start = F.lit(1.0 / n)
    ranks, written, done = nodes.select("id", start.alias("r")), None, 0
    while done < max_iter:
        new = ranks
        # each step reads the ranks before it once, so steps can be chained; with a bound each is judged
        for _ in range(min(STEPS_PER_ROUND, max_iter - done) if delta_min is None else 1):
            got = weighted.join(new.select(F.col("id").alias("src_id"), "r"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.sum(F.col("r") * F.col("part")).alias("s"))
            new = nodes.join(got, "id", "left").select("id", F.when(F.col("fed"), (1 - beta) * F.col("s") + F.lit(beta / n)).otherwise(start).alias("r"))
            done += 1
        if delta_min is None:
            rows, seen = store.write(new)
        else:
            old = ranks.select("id", F.col("r").alias("old"))
            rows, seen = store.write(new.join(old, "id"), moved=F.max(F.abs(F.col("r") - F.col("old"))))
        store.drop(written)
        written, ranks = rows, rows.select("id", "r")
        if delta_min is not None and seen["moved"] <= delta_min:
            break
    return ranks.select("id", F.col("r").alias("attr"))
