"""Communities by parallel Louvain, modularity, and agreement of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph
from graphlake.storage import Rounds

#: Fixed constants of the small generator that schedules vertices: next = 48271 * x mod 255.
MULTIPLIER, MODULUS = 48271, 255


def next_random(seed: Column) -> Column:
    """The next number of the scheduling generator."""
    return F.pmod(F.lit(MULTIPLIER) * seed.cast("bigint"), F.lit(MODULUS))


def canonical_edges(graph: PropertyGraph, weight: str | None = None, dedupe: bool = False) -> DataFrame:
    """(a, b, w) with a <= b: total weight between two vertices, 1 an edge without a weight column.

    ``dedupe`` counts edges with the same ends and weight once, whichever way
    they point. Edges of null weight are dropped.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = graph.edges.select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b"), w.alias("w")).filter(F.col("w").isNotNull())
    return (e.distinct() if dedupe else e).groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): one row, for canonical edges (a, b, w) and members (vid, cid); 0 without edges."""
    a, b = members.select(F.col("vid").alias("a"), F.col("cid").alias("ca")), members.select(F.col("vid").alias("b"), F.col("cid").alias("cb"))
    e = edges.join(a, "a").join(b, "b")
    # one row a community: weight inside, and total degree, where an edge adds its weight at both ends
    half = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside"), F.col("w").alias("deg")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inside"), F.col("w").alias("deg")))).alias("x")
    per = e.select(half).groupBy("x.c").agg(F.sum("x.inside").alias("inside"), F.sum("x.deg").alias("deg"))
    m2 = F.sum("deg")
    out = per.agg(F.sum("inside").alias("i"), F.sum(F.col("deg") * F.col("deg")).alias("d2"), m2.alias("m2"))
    return out.select(F.coalesce(2 * F.col("i") / F.col("m2") - F.lit(resolution) * F.col("d2") / (F.col("m2") * F.col("m2")), F.lit(0.0)).alias("modularity"))


def louvain(graph: PropertyGraph, max_iter: int = 8, max_iter_stage1: int = 16, max_iter_no_change: int = 4, weight: str | None = None, resolution: float = 1.0, dedupe: bool = False, seed: int = 1) -> DataFrame:
    """(vid, cid): a community for every end of an edge; cid is the smallest vertex of the community.

    Stage one moves vertices: in each round half of them, by a hash, take the neighbouring community with the greatest gain; ties stay
    where they are or go by a hash. It ends after ``max_iter_stage1`` rounds, after
    ``max_iter_no_change`` rounds without a gain, or when modularity falls after
    two rounds, in which case these are undone. Stage two contracts communities to
    vertices. Both repeat up to ``max_iter`` times, or until nothing moves.
    The same seed gives the same communities. ``resolution=2`` weighs degrees
    as a norm that counts inner edges once does.
    """
    store = Rounds(graph.edges.sparkSession, "louvain")
    edges, seen = store.write(canonical_edges(graph, weight, dedupe), n=F.count(F.lit(1)), m=F.sum("w"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    if not seen["n"] or not seen["m"]:
        return ends.select("vid", F.col("vid").alias("cid"))
    m2 = 2.0 * seen["m"]
    whole, _ = store.write(ends.select("vid", F.col("vid").alias("cid")))
    for level in range(max_iter):
        moved, any_move = _move(store, edges, m2, max_iter_stage1, max_iter_no_change, resolution, seed + 1000 * level)
        if not any_move:
            break
        up = moved.select(F.col("v").alias("cid"), F.col("c").alias("up"))
        whole, _ = store.write(whole.join(up, "cid").select("vid", F.col("up").alias("cid")))
        a, b = moved.select(F.col("v").alias("a"), F.col("c").alias("ca")), moved.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        edges, _ = store.write(edges.join(a, "a").join(b, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
    least = whole.groupBy("cid").agg(F.min("vid").alias("least"))
    return whole.join(least, "cid").select("vid", F.col("least").alias("cid"))


def _move(store: Rounds, edges: DataFrame, m2: float, max_rounds: int, max_still: int, resolution: float, seed: int) -> tuple[DataFrame, bool]:
    """((v, c) after the rounds of stage one, whether any vertex moved)."""
    arcs = edges.filter("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u"), "w"), F.struct(F.col("b").alias("v"), F.col("a").alias("u"), "w"))).alias("x")).select("x.v", "x.u", "x.w")
    degree, _ = store.write(edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), "w"), F.struct(F.col("b").alias("v"), "w"))).alias("x")).groupBy("x.v").agg(F.sum("x.w").alias("k")))
    state, _ = store.write(degree.select("v", "k", F.col("v").alias("c")))
    quality = modularity(edges, state.select(F.col("v").alias("vid"), F.col("c").alias("cid")), resolution).first()[0]
    still, ever, moves, best = 0, False, 0, state
    for r in range(max_rounds):
        totals = state.groupBy("c").agg(F.sum("k").alias("kc"))
        # weight from a vertex to each community it touches, its own with at least 0
        to = arcs.join(state.select(F.col("v").alias("u"), "c"), "u").select("v", "c", "w").unionByName(state.select("v", "c", F.lit(0.0).alias("w"))).groupBy("v", "c").agg(F.sum("w").alias("wc"))
        options = to.join(state.select("v", "k", F.col("c").alias("c0")), "v").join(totals, "c")
        # gain against standing alone: the vertex does not count in its own community
        stays = F.col("c") == F.col("c0")
        rest = F.col("kc") - F.when(stays, F.col("k")).otherwise(F.lit(0.0))
        gain = F.col("wc") - F.lit(resolution) * F.col("k") * rest / F.lit(m2)
        # the best option as the maximum of a struct: folded before the shuffle, no window
        top = options.groupBy("v").agg(F.max_by("c", F.struct(gain.alias("g"), stays.cast("int").alias("s"), F.xxhash64("c").alias("h"))).alias("want"), F.first("k").alias("k"), F.first("c0").alias("before"))
        turn = F.pmod(F.xxhash64("v", F.lit(seed + r // 2)) + F.lit(r % 2), F.lit(2)) == 0
        nxt = top.select("v", "k", F.when(turn, F.col("want")).otherwise(F.col("before")).alias("c"), "before")
        written, seen = store.write(nxt, moves=F.count_if(F.col("c") != F.col("before")))
        moved = written.select("v", "k", "c")
        moves += seen["moves"]
        state = moved
        if r % 2 == 0 and r + 1 < max_rounds:
            continue  # both halves of the vertices have their turn before the result is judged
        q = modularity(edges, state.select(F.col("v").alias("vid"), F.col("c").alias("cid")), resolution).first()[0] if moves else quality
        if q < quality:
            break
        still = 0 if q > quality + 1e-9 else still + 2
        best, quality, ever, moves = state, q, ever or moves > 0, 0
        if still >= max_still:
            break
    return best.select("v", "c"), ever


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ca, cb, n): how many vertices two partitions (vid, cid) put into each pair of communities."""
    return a.select("vid", F.col("cid").alias("ca")).join(b.select("vid", F.col("cid").alias("cb")), "vid").groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("n"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """(nmi): normalised mutual information, 2 I / (H(a) + H(b)); 1 if both partitions are one community."""
    t = contingency(a, b)
    ra, rb = t.groupBy("ca").agg(F.sum("n").alias("na")), t.groupBy("cb").agg(F.sum("n").alias("nb"))
    total = t.agg(F.sum("n").alias("t"))
    info = t.join(ra, "ca").join(rb, "cb").join(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("i"))
    h = lambda d, c, name: d.join(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(name))
    both = info.join(h(ra, "na", "ha")).join(h(rb, "nb", "hb"))
    return both.select(F.when(F.col("ha") + F.col("hb") == 0, F.lit(1.0)).otherwise(2 * F.col("i") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def ari(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ari): adjusted Rand index, 1 if the partitions agree, about 0 for chance."""
    t = contingency(a, b)
    two = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("double")
    s = t.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("t"))
    sa = t.groupBy("ca").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sa"))
    sb = t.groupBy("cb").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sb"))
    x = s.join(sa).join(sb)
    expected = F.col("sa") * F.col("sb") / two("t")
    most = (F.col("sa") + F.col("sb")) / 2
    return x.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))
