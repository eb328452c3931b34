"""Consolidating pairwise matches into groups (problem 1), by hash-to-min.

Every vertex v keeps a cluster C(v), at first its neighbours and itself. In
each round v sends C(v) to the smallest member of C(v), and that minimum to
all other members; what a vertex receives is its next cluster. The number of
rounds grows with the logarithm of the longest chain.

Clusters are kept as rows (v, u), never as arrays: the minimum of a giant
component owns a large part of the rows. Rows of such a hot vertex are not
shuffled by it; they get its minimum by a broadcast whose size is bounded.

A vertex whose cluster is one smaller vertex m is settled. Whoever held it in
the round before sent the same minimum m, so only m holds it now: it needs no
further messages and is put aside with m as its parent. Rounds therefore
shrink to what still moves, and end when nothing does. Parents of vertices
that are put aside later are followed to the end by links that double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators import skew
from graphlake.storage import Rounds


def match_groups(pair_tables: Sequence[DataFrame], max_rounds: int = 200) -> DataFrame:
    """(group_id, vid): one row per vertex of a pair; group_id is the smallest vid linked to it.

    ``pair_tables`` hold pairs in their first two columns; further columns are
    not read. Pairs with a null end link nothing and name no vertex. A pair of
    a vertex with itself makes a group of one. Repeated and opposite pairs
    count once. Empty tables give no rows.
    """
    store = Rounds(pair_tables[0].sparkSession, "match-groups")
    pairs = None
    for t in pair_tables:
        a, b = t.columns[:2]
        part = t.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        pairs = part if pairs is None else pairs.unionAll(part)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x")).select("x.v", "x.u")
    first, seen = store.write(both.distinct().withColumn("settled", F.lit(False)), n=F.count_if(F.col("v") != F.col("u")))
    alone = first.filter("v = u").select("v", F.col("u").alias("p"))
    written, active = [], first.filter("v <> u").select("v", "u")
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        least = active.groupBy("v").agg(F.min("u").alias("mu"), F.count(F.lit(1)).alias("n"))
        kept = None
        if seen["n"] > skew.HOT_ROWS:
            least, _ = store.write(least)
            kept = least
        table, seen = store.write(_round(active, least, seen["n"]), n=F.count_if(~F.col("settled")))
        store.drop(kept)
        written.append(table)
        active = table.filter("not settled").select("v", "u")
    else:
        raise RuntimeError(f"clusters still change after {max_rounds} rounds")
    parents = None
    for t in written:
        part = t.filter("settled").select(F.col("u").alias("v"), F.col("v").alias("p"))
        parents = part if parents is None else parents.unionAll(part)
    if parents is not None:
        parents = _roots(store, parents, max_rounds)
        store.drop(*written)
        alone = alone.unionAll(parents).unionAll(parents.select(F.col("p").alias("v"), "p"))
    return alone.groupBy(F.col("v").alias("vid")).agg(F.min("p").alias("group_id")).select("group_id", "vid")


def _round(active: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(v, u, settled): the next clusters, and as settled those rows whose u holds nothing but v and is put aside."""
    joined = skew.join_to_keys(active, least, "v", total, "n").withColumn("m", F.least("v", "mu"))
    msg = lambda a, b, mark: F.struct(F.col(a).alias("v"), F.col(b).alias("u"), F.lit(mark).alias("mark"))
    # members to the minimum and the minimum to the members; the vertex itself, also a member, once with its least row
    ordinary = F.when(F.col("u") == F.col("mu"), F.array(msg("m", "u", False), msg("u", "m", False), msg("m", "v", False), msg("v", "m", False))).otherwise(F.array(msg("m", "u", False), msg("u", "m", False)))
    # a cluster of one smaller vertex only tells it so
    sent = F.when((F.col("n") == 1) & (F.col("mu") < F.col("v")), F.array(msg("mu", "v", True))).otherwise(ordinary)
    rows = joined.select(F.explode(sent).alias("x")).select("x.*").filter("v <> u")
    # a mark without the row itself came too late: the row went on to a smaller vertex, or is put aside already
    return rows.groupBy("v", "u").agg(F.max("mark").alias("settled"), F.min("mark").alias("only")).filter("not only").select("v", "u", "settled")


def _roots(store: Rounds, parents: DataFrame, max_rounds: int) -> DataFrame:
    """(v, p) with p followed to a vertex that has no parent; one row a vertex in and out."""
    links, _ = store.write(parents)
    for _ in range(max_rounds):
        # one row a v on the right and the long side on the left: the adaptive skew join can split a p that many share
        above = links.select(F.col("v").alias("p"), F.col("p").alias("q"))
        nxt, seen = store.write(links.join(above, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), n=F.count_if(F.col("moved")))
        nxt_links = nxt.select("v", "p")
        nxt_links._round_path = nxt._round_path
        store.drop(links)
        links = nxt_links
        if not seen["n"]:
            return links
    raise RuntimeError(f"parents still change after {max_rounds} rounds")
