"""Parent-child rows to full hierarchies: paths, depth, root, descendants, cycles (problem 4).

Three passes over one row per vertex:

* upward: the size of each subtree, summed over the 1, 2, 4, ... levels below;
  a vertex whose link never reaches a root stays unprocessed, it is on or
  below a cycle;
* siblings: the preorder range of each child inside its parent, by prefix sums
  of the sizes of the siblings before it, in the order of their ids;
* downward, for the processed vertices: offsets, depth and path added up along
  the links to the 1, 2, 4, ... levels above, which places every subtree in one
  nested-set range.

Links double each round, so a tree of depth d takes log2(d) rounds. Whether
one vertex is below another is then a comparison of ranges: ``descendants`` of
given vertices cuts their ranges into aligned blocks of powers of two, so that
range and position meet by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.operators.skew import running_totals
from graphlake.storage import Rounds

#: Siblings summed in one window task, about.
SIBLINGS_PER_BUCKET = 100_000


def hierarchy(edges: DataFrame, parent: Column, child: Column, max_rounds: int = 64) -> DataFrame:
    """(vid, parent_vid, root_vid, depth, path, lft, rgt, several), one row per vertex of a link with both ends.

    ``lft`` and ``rgt`` are the nested-set range of the vertex within its root:
    x is a descendant of y if both have one root and y.lft < x.lft <= y.rgt.
    ``path`` joins the ids from the root by '/'. A vertex on or below a cycle,
    its own parent included, has root_vid -1, depth -1, an empty path and null
    ranges. Repeated links count once, links with a null end not at all. If a
    child has several parents, the smallest is its parent and ``several`` is
    true; ``other_parents`` lists the others. An empty table gives no rows.
    """
    store = Rounds(edges.sparkSession, "hierarchy")
    links = _links(edges, parent, child)
    # one row a vertex: its parent, or null at a root
    ends = links.select(F.explode(F.array(F.struct("v", "p"), F.struct(F.col("p").alias("v"), F.lit(None).cast("bigint").alias("p")))).alias("x")).select("x.v", "x.p")
    nodes, seen = store.write(ends.groupBy("v").agg(F.min("p").alias("p"), F.coalesce(F.min("p") != F.max("p"), F.lit(False)).alias("several")), n=F.count(F.lit(1)))

    sizes = _subtree_sizes(store, nodes, max_rounds)
    placed = _downward(store, _sibling_offsets(store, sizes.filter("not open"), seen["n"]), max_rounds)
    on_cycle = sizes.filter("open")
    none = lambda t: F.lit(None).cast(t)
    whole = placed.select(F.col("v").alias("vid"), F.col("p").alias("parent_vid"), F.col("top").alias("root_vid"), "depth", "path", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), "several")
    lost = on_cycle.select(F.col("v").alias("vid"), F.col("p").alias("parent_vid"), F.lit(-1).cast("bigint").alias("root_vid"), F.lit(-1).cast("bigint").alias("depth"), F.lit("").alias("path"), none("bigint").alias("lft"), none("bigint").alias("rgt"), "several")
    return whole.unionByName(lost)


def _links(edges: DataFrame, parent: Column, child: Column) -> DataFrame:
    return edges.select(parent.cast("bigint").alias("p"), child.cast("bigint").alias("v")).filter(F.col("p").isNotNull() & F.col("v").isNotNull())


def other_parents(edges: DataFrame, parent: Column, child: Column, tree: DataFrame) -> DataFrame:
    """(vid, parent_vid) of the links that the ``hierarchy`` of the same edges does not follow, once each."""
    few = tree.filter("several").select(F.col("vid").alias("v"), "parent_vid")
    return _links(edges, parent, child).join(few, "v").filter(F.col("p") != F.col("parent_vid")).select(F.col("v").alias("vid"), F.col("p").alias("parent_vid")).distinct()


def _subtree_sizes(store: Rounds, nodes: DataFrame, max_rounds: int) -> DataFrame:
    """(v, p, several, size, open): vertices within reach below, and whether the link upward never ended.

    Round k knows the 2**k levels below: a vertex adds what its descendants
    2**k levels down know. The partial sums fold a parent's children before
    the shuffle, so a parent with very many is no bottleneck.
    """
    state = nodes.select("v", "p", "several", F.col("p").alias("up"), F.lit(1).cast("bigint").alias("size"))
    still = None
    for _ in range(max_rounds):
        below = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("v")).agg(F.sum("size").alias("more"))
        grown = state.join(below, "v", "left").select("v", "p", "several", "up", "size", F.coalesce("more", F.lit(0)).alias("more"))
        above = state.select(F.col("v").alias("up"), F.col("up").alias("up2"))
        # vertices whose link has ended need no lookup and skip the second join
        moving = grown.filter(F.col("up").isNotNull()).join(above, "up").select("v", "p", "several", F.col("up2").alias("up"), (F.col("size") + F.col("more")).alias("size"))
        ended = grown.filter(F.col("up").isNull()).select("v", "p", "several", "up", (F.col("size") + F.col("more")).alias("size"))
        nxt, seen = store.write(moving.unionByName(ended), n=F.count_if(F.col("up").isNotNull()))
        store.drop(state)
        state = nxt
        # open links that none of the others left: each is on or below a cycle
        if seen["n"] in (0, still):
            break
        still = seen["n"]
    return state.withColumn("open", F.col("up").isNotNull()).drop("up")


def _sibling_offsets(store: Rounds, tree: DataFrame, n: int) -> DataFrame:
    """(v, p, several, size, own, base): own is 1 and the sizes of all rows before it in the order of (p, v), base that
    sum before the first child of v. The place of a vertex behind its parent is own less the base of its parent.

    The rows are cut by range of (p, v), so that no task holds all children of
    one parent, and summed within the cuts and over the cuts.
    """
    kids = tree.filter(F.col("p").isNotNull())
    placed, _ = store.write(running_totals(store, kids.select("v", "p", "several", "size"), ["p", "v"], {"own": F.col("size")}, n, SIBLINGS_PER_BUCKET))
    base = placed.groupBy(F.col("p").alias("v")).agg(F.min("own").alias("base"))
    roots = tree.filter(F.col("p").isNull()).select("v", "p", "several", "size", F.lit(-1).cast("bigint").alias("own"))
    return placed.unionByName(roots).join(base, "v", "left").select("v", "p", "several", "size", (F.col("own") + 1).alias("own"), F.coalesce("base", F.lit(0)).alias("base"))


def _downward(store: Rounds, nodes: DataFrame, max_rounds: int) -> DataFrame:
    """(v, p, several, size, top, depth, lft, path) of vertices that all reach a root.

    ``gone`` adds up own less base of a vertex and of those above it; a
    vertex has its own base given back.
    """
    state, seen = store.write(
        nodes.select("v", "p", "several", "size", "base", F.col("p").alias("up"), F.coalesce("p", "v").alias("top"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), (F.col("own") - F.col("base")).alias("gone"), F.col("v").cast("string").alias("path")),
        n=F.count_if(F.col("up").isNotNull()),
    )
    # path holds the ids after the one that up names, so a vertex without up has its whole path
    for _ in range(max_rounds):
        if not seen["n"]:
            return state.withColumn("lft", F.col("gone") + F.col("base"))
        above = state.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("d2"), F.col("gone").alias("g2"), F.col("path").alias("path2"))
        moved = state.filter(F.col("up").isNotNull()).join(above, "up").select("v", "p", "several", "size", "base", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("gone") + F.col("g2")).alias("gone"), F.concat_ws("/", "path2", "path").alias("path"))
        nxt, seen = store.write(moved.unionByName(state.filter(F.col("up").isNull())), n=F.count_if(F.col("up").isNotNull()))
        store.drop(state)
        state = nxt
    raise RuntimeError(f"a tree is deeper than 2**{max_rounds}")


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(vid, descendant_vid, levels) for the vertices ``of.vid`` of a ``hierarchy`` result, or for all of its vertices.

    For all, each vertex emits the ancestors that its path names, so the work
    is the number of pairs. For given ones, their ranges meet the positions
    of the other vertices (``_blocks``), so that a pair is found once and no
    two vertices of a root are compared otherwise. Vertices on or below a
    cycle have none; a repeated ``of.vid`` counts once.
    """
    if of is None:
        above = F.posexplode(F.transform(F.slice(F.split("path", "/"), F.lit(1), F.col("depth").cast("int")), lambda x: x.cast("bigint"))).alias("i", "vid")
        pairs = tree.filter(F.col("depth") > 0).select(F.col("vid").alias("descendant_vid"), "depth", above)
        return pairs.select("vid", "descendant_vid", (F.col("depth") - F.col("i")).alias("levels"))
    heads = tree.filter(F.col("rgt") > F.col("lft")).join(of.select("vid").distinct(), "vid", "left_semi")
    blocks = heads.select("vid", "root_vid", F.col("depth").alias("above"), F.explode(_blocks()).alias("b")).select("vid", "root_vid", "above", "b.level", "b.block")
    used = [r["level"] for r in blocks.select("level").distinct().collect()]  # at most 63 numbers
    levels = F.array(*map(F.lit, sorted(used))) if used else F.array().cast("array<int>")
    points = tree.filter(F.col("depth") > 0).select(F.col("vid").alias("descendant_vid"), "root_vid", "depth", "lft", F.explode(levels).alias("level"))
    points = points.select("descendant_vid", "root_vid", "depth", "level", F.expr("shiftright(lft, level)").alias("block"))
    return points.join(blocks, ["root_vid", "level", "block"]).select("vid", "descendant_vid", (F.col("depth") - F.col("above")).alias("levels"))


def _blocks() -> Column:
    """The positions after ``lft`` up to ``rgt`` as blocks (level, block) of 2**level positions, block * 2**level the first: two a level at most."""
    low, high = "shiftright(lft + shiftleft(1L, k), k)", "shiftright(rgt + 1, k)"  # first block inside the range, first behind it
    some = f"{low} < {high}"
    pick = f"array(if({some} and {low} % 2 = 1, named_struct('level', k, 'block', {low}), null), if({some} and {high} % 2 = 1, named_struct('level', k, 'block', {high} - 1), null))"
    return F.expr(f"filter(flatten(transform(sequence(0, cast(ceil(log2(rgt - lft + 1)) as int)), k -> {pick})), x -> x is not null)")
