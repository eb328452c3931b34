"""Graph queries over the test tables, with their SQL.

Two graphs are read from the order tables: ``trade``, a multigraph between
customers, and ``tree``, the layers region, nation, customer, order. Others
come from the table ``edges``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.operators import community, dag, paths, rank, shortest, traversal, triangles
from graphlake.operators.components import weakly_connected_components
from graphlake.operators.graph import PropertyGraph
from graphlake.operators.lookup import lookup_edges, lookup_vertices
from graphlake.operators.metapath import meta_path_search
from graphlake.sources.readers import graph_from_json_tables, json_property, load_edges, write_edges
from graphlake.storage import Rounds, read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def trade(spark: SparkSession, d: str) -> PropertyGraph:
    """Customer to customer, an edge an order; type is its status, weight its whole price."""
    n = read_table(spark, d, "customer").count()
    o = read_table(spark, d, "orders")
    return PropertyGraph(o.select(F.col("o_custkey").alias("src_id"), (F.col("o_orderkey") % n).alias("dst_id"), F.col("o_orderkey").alias("eid"), F.col("o_orderstatus").alias("etype"), F.floor("o_totalprice").alias("weight")))


def tree(spark: SparkSession, d: str) -> PropertyGraph:
    """Region to nation to customer to order; weights are whole numbers."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, customer, orders = (read_table(spark, d, t) for t in ("nation", "customer", "orders"))
    part = lambda df, s, t, e, w: df.select(s.alias("src_id"), t.alias("dst_id"), F.lit(e).alias("etype"), w.cast("bigint").alias("weight"))
    e = part(nation, name("r", "n_regionkey"), name("n", "n_nationkey"), "nation", F.col("n_nationkey"))
    e = e.unionByName(part(customer, name("n", "c_nationkey"), name("c", "c_custkey"), "customer", F.floor("c_acctbal")))
    e = e.unionByName(part(orders, name("c", "o_custkey"), name("o", "o_orderkey"), "order", F.floor("o_totalprice")))
    return PropertyGraph(e)


def links(spark: SparkSession, d: str) -> PropertyGraph:
    """The table edges, each edge once however often it was delivered."""
    e = read_table(spark, d, "edges").select("eid", "src_id", "dst_id", "edge_type", "edge_weight").distinct()
    return PropertyGraph.from_edges(e)


def hub(graph: PropertyGraph):
    """The vertex with most out-edges, ties by the smallest id."""
    return graph.edges.groupBy("src_id").count().orderBy(F.desc("count"), "src_id").first()["src_id"]


_TRADE = """trade AS (SELECT o_custkey AS src_id, o_orderkey % (SELECT count(*) FROM customer) AS dst_id, o_orderkey AS eid, o_orderstatus AS etype,
  CAST(floor(o_totalprice) AS BIGINT) AS weight FROM orders)"""
_HUB = "hub AS (SELECT src_id AS s FROM trade GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_TREE = """tree AS (SELECT 'r' || n_regionkey AS src_id, 'n' || n_nationkey AS dst_id, 'nation' AS etype, CAST(n_nationkey AS BIGINT) AS weight FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'customer', CAST(floor(c_acctbal) AS BIGINT) FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'order', CAST(floor(o_totalprice) AS BIGINT) FROM orders)"""
_LINKS = "links AS (SELECT DISTINCT eid, src_id, dst_id, edge_type, edge_weight FROM edges WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


_DEGREES = """SELECT vid, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
  SELECT src_id AS vid, 0 AS i, 1 AS o FROM trade UNION ALL SELECT dst_id, 1, 0 FROM trade) GROUP BY 1"""


@query(_with(_TRADE) + _DEGREES)
def degrees(spark, d):
    return trade(spark, d).degrees()


@query(_with(_TRADE) + _DEGREES)
def load_edges_degrees(spark, d):
    """Edges written as delimited lines, read back, and their degrees."""
    path = Rounds(spark, "edge-lines").base
    write_edges(trade(spark, d), path)
    return load_edges(spark, path).degrees()


@query(r"""SELECT owner_vertex AS src_id, other_vertex AS dst_id, etype,
  CASE WHEN json_valid(properties) THEN try_cast(properties ->> '$.weight' AS DOUBLE) END AS weight,
  coalesce(CASE WHEN json_valid(properties) THEN try_cast(properties ->> '$.since' AS BIGINT) END, 0) AS since
FROM g_oe WHERE owner_vertex IS NOT NULL AND other_vertex IS NOT NULL""")
def json_edges(spark, d):
    """Edges with properties taken out of JSON text."""
    g = graph_from_json_tables(read_table(spark, d, "g_oe"), weight_key="weight")
    return g.edges.select("src_id", "dst_id", "etype", "weight", F.coalesce(json_property("properties", "since", "bigint"), F.lit(0)).alias("since"))


# --- breadth-first search, reachability, neighbourhoods, walk counts


def _bfs_sql(typed: str = "") -> str:
    t = f"g AS (SELECT * FROM trade {typed})"
    return _with(_TRADE, t, _HUB.replace("trade", "g"), "r(id, hop) AS (SELECT s, 0 FROM hub UNION SELECT g.dst_id, hop + 1 FROM r JOIN g ON g.src_id = r.id WHERE hop < 30)",
                 "l AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1)", recursive=True)


_BFS = """SELECT DISTINCT src_id, dst_id, 0 AS attr FROM g WHERE src_id = (SELECT s FROM hub)
UNION ALL SELECT DISTINCT g.src_id, g.dst_id, a.hop FROM g JOIN l a ON a.id = g.src_id JOIN l b ON b.id = g.dst_id WHERE a.hop > 0 AND b.hop = a.hop + 1"""


@query(_bfs_sql() + _BFS)
def bfs_levels(spark, d):
    g = trade(spark, d)
    return traversal.bfs_from(g, hub(g))


@query(_bfs_sql("WHERE etype = 'O'") + _BFS)
def bfs_typed(spark, d):
    g = trade(spark, d).of_type("O")
    return traversal.bfs_from(g, hub(g))


@query(_bfs_sql("WHERE etype = 'P'") + "SELECT id, CAST(hop AS INT) AS hop FROM l")
def reachability(spark, d):
    g = trade(spark, d).of_type("P")
    return shortest.distances(g, hub(g))


def _near(typed: str, k: int) -> str:
    return _with(_TRADE, f"g AS (SELECT * FROM trade {typed})", _HUB.replace("trade", "g"),
                 "w AS (SELECT src_id AS a, dst_id AS b, 1 AS d FROM g UNION ALL SELECT dst_id, src_id, -1 FROM g)",
                 f"r(id, hop) AS (SELECT s, 0 FROM hub UNION SELECT w.b, hop + 1 FROM r JOIN w ON w.a = r.id WHERE hop < {k})",
                 "l AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1)", recursive=True)


@query(_near("", 2) + "SELECT id, CAST(hop AS INT) AS attr FROM l")
def neighbours_vertices(spark, d):
    g = trade(spark, d)
    return traversal.neighbours(g, hub(g), 2)


_NEAR_EDGES = """, met AS (SELECT a, b, d FROM w WHERE a = (SELECT s FROM hub)
  UNION ALL SELECT DISTINCT a, b, d FROM w JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE x.hop > 0 AND y.hop = x.hop + 1)
SELECT CASE WHEN d = 1 THEN a ELSE b END AS src_id, CASE WHEN d = 1 THEN b ELSE a END AS dst_id FROM met"""


@query(_near("", 2).rstrip() + _NEAR_EDGES)
def neighbours_edges(spark, d):
    g = trade(spark, d)
    return traversal.neighbours(g, hub(g), 2, edges=True)


@query(_near("WHERE etype = 'F'", 3) + "SELECT id, CAST(hop AS INT) AS attr FROM l")
def neighbours_typed(spark, d):
    g = trade(spark, d).of_type("F")
    return traversal.neighbours(g, hub(g), 3)


def _walk_sql(kind: str, typed: str = "") -> str:
    def side(n: str, a: str, b: str) -> str:
        return f"""{n}1 AS (SELECT {a} AS id, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1),
{n}2 AS (SELECT g.{a} AS id, CAST(sum(n) AS BIGINT) AS n FROM g JOIN {n}1 x ON x.id = g.{b} GROUP BY 1),
{n}3 AS (SELECT g.{a} AS id, CAST(sum(n) AS BIGINT) AS n FROM g JOIN {n}2 x ON x.id = g.{b} GROUP BY 1),
{n} AS (SELECT id, max(n) AS attr FROM (SELECT * FROM {n}1 UNION ALL SELECT * FROM {n}2 UNION ALL SELECT * FROM {n}3) GROUP BY 1)"""

    last = {"o": "SELECT id, attr FROM o", "i": "SELECT id, attr FROM i", "b": "SELECT id, CAST(sum(attr) AS BIGINT) AS attr FROM (SELECT * FROM o UNION ALL SELECT * FROM i) GROUP BY 1"}[kind]
    return _with(_TRADE, f"g AS (SELECT * FROM trade {typed})", side("o", "src_id", "dst_id"), side("i", "dst_id", "src_id")) + last


@query(_walk_sql("o"))
def out_walk_count(spark, d):
    return traversal.out_walk_count(trade(spark, d), 3)


@query(_walk_sql("i"))
def in_walk_count(spark, d):
    return traversal.in_walk_count(trade(spark, d), 3)


@query(_walk_sql("b"))
def walk_count(spark, d):
    return traversal.walk_count(trade(spark, d), 3)


@query(_walk_sql("o", "WHERE etype = 'F'"))
def out_walk_count_typed(spark, d):
    return traversal.out_walk_count(trade(spark, d).of_type("F"), 3)


@query(_walk_sql("i", "WHERE etype = 'F'"))
def in_walk_count_typed(spark, d):
    return traversal.in_walk_count(trade(spark, d).of_type("F"), 3)


@query(_walk_sql("b", "WHERE etype = 'F'"))
def walk_count_typed(spark, d):
    return traversal.walk_count(trade(spark, d).of_type("F"), 3)


@query(_with(_TRADE, "p AS (SELECT src_id, dst_id FROM trade UNION SELECT a.src_id, b.dst_id FROM trade a JOIN trade b ON a.dst_id = b.src_id)") + "SELECT src_id AS id, CAST(count(*) AS BIGINT) AS attr FROM p GROUP BY 1")
def k_hop_distinct_count(spark, d):
    return traversal.k_hop_distinct_count(trade(spark, d), 2)


# --- walks as paths


_WALKS = """w AS (SELECT [src_id] AS path, src_id AS tail, CAST([] AS BIGINT[]) AS attrs, 0 AS n FROM (SELECT DISTINCT src_id FROM g WHERE src_id IN (SELECT id FROM starts))
  UNION ALL SELECT list_append(path, g.dst_id), g.dst_id, list_append(attrs, g.weight), n + 1 FROM w JOIN g ON g.src_id = w.tail WHERE n < {k}),
done AS (SELECT path, attrs FROM w WHERE n = {k} OR tail NOT IN (SELECT src_id FROM g)),
rows AS (SELECT array_to_string(path, '-') AS path_text, path, attrs, unnest(range(len(path) - 1)) AS k FROM done)"""


def _walks(graph: str, starts: str, k: int, cols: str, name: str = "tree") -> str:
    base = {"tree": _TREE, "links": _LINKS}[name]
    return _with(base, f"g AS ({graph})", f"starts AS ({starts})", _WALKS.format(k=k), recursive=True) + f"SELECT {cols} FROM rows"


_EDGE = "path_text, CAST(k AS INT) AS edge_idx, path[k + 1] AS src_id, path[k + 2] AS dst_id"
_FORTH, _BACK = "SELECT * FROM tree", "SELECT dst_id AS src_id, src_id AS dst_id, etype, weight FROM tree"
_REGIONS, _ORDERS = "SELECT 'r' || r_regionkey AS id FROM region", "SELECT 'o' || o_orderkey AS id FROM orders"


def _regions(spark, d):
    return read_table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))


def _orders(spark, d):
    return read_table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))


@query(_walks(_FORTH, _REGIONS, 4, _EDGE))
def paths_from_tree(spark, d):
    return paths.path_edge_rows(paths.walks_from(tree(spark, d), _regions(spark, d), 4))


@query(_walks(_FORTH, _REGIONS, 4, _EDGE + ", attrs[k + 1] AS attr"))
def paths_from_attr(spark, d):
    return paths.path_edge_rows(paths.walks_from(tree(spark, d), _regions(spark, d), 4, attr="weight"), attr="weight")


@query(_walks(_FORTH + " WHERE etype = 'nation'", _REGIONS, 4, _EDGE))
def paths_from_typed(spark, d):
    return paths.path_edge_rows(paths.walks_from(tree(spark, d).of_type("nation"), _regions(spark, d), 4))


@query(_walks(_FORTH + " WHERE etype = 'nation'", _REGIONS, 4, _EDGE + ", attrs[k + 1] AS attr"))
def paths_from_typed_attr(spark, d):
    return paths.path_edge_rows(paths.walks_from(tree(spark, d).of_type("nation"), _regions(spark, d), 4, attr="weight"), attr="weight")


@query(_walks(_FORTH, _REGIONS, 2, "CAST(dense_rank() OVER (ORDER BY path) AS BIGINT) AS pathid, CAST(k AS INT) AS edge_idx, path[k + 1] AS src_id, path[k + 2] AS dst_id"))
def paths_from_numbered(spark, d):
    """Walks of at most two edges, numbered."""
    return paths.paths_from(tree(spark, d), _regions(spark, d), 2)


@query(_walks(_BACK, _ORDERS, 4, _EDGE))
def backtrack_tree(spark, d):
    return paths.path_edge_rows(paths.walks_from(tree(spark, d).reversed(), _orders(spark, d), 4))


@query(_walks(_BACK, _ORDERS, 4, _EDGE + ", attrs[k + 1] AS attr"))
def backtrack_attr(spark, d):
    return paths.path_edge_rows(paths.walks_from(tree(spark, d).reversed(), _orders(spark, d), 4, attr="weight"), attr="weight")


@query(_walks(_BACK + " WHERE etype = 'order'", _ORDERS, 4, _EDGE))
def backtrack_typed(spark, d):
    return paths.path_edge_rows(paths.walks_from(tree(spark, d).of_type("order").reversed(), _orders(spark, d), 4))


@query(_walks(_BACK + " WHERE etype = 'order'", _ORDERS, 4, _EDGE + ", attrs[k + 1] AS attr"))
def backtrack_typed_attr(spark, d):
    return paths.path_edge_rows(paths.walks_from(tree(spark, d).of_type("order").reversed(), _orders(spark, d), 4, attr="weight"), attr="weight")


_ROOTED = "SELECT src_id, dst_id, edge_type AS weight FROM links WHERE edge_type = 3"


@query(_walks(_ROOTED, "SELECT src_id AS id FROM links WHERE edge_type = 3 AND src_id NOT IN (SELECT dst_id FROM links WHERE edge_type = 3)", 6, _EDGE, name="links"))
def paths_from_roots(spark, d):
    """Walks of at most six hierarchy edges from every vertex without a parent."""
    g = links(spark, d).of_type(3, "edge_type")
    roots = g.links().select(F.col("src_id").alias("id")).distinct().join(g.links().select(F.col("dst_id").alias("id")), "id", "left_anti")
    return paths.path_edge_rows(paths.walks_from(g, roots, 6))


@query(_with(_TREE, "roots AS (SELECT DISTINCT src_id FROM tree WHERE src_id NOT IN (SELECT dst_id FROM tree))",
             "w AS (SELECT src_id AS tail, CAST(src_id AS VARCHAR) AS path, CAST(0 AS BIGINT) AS length FROM roots UNION ALL SELECT dst_id, path || '-->' || dst_id, length + 1 FROM w JOIN tree ON src_id = tail)", recursive=True)
       + "SELECT path, length FROM w WHERE length = (SELECT max(length) FROM w)")
def longest_paths(spark, d):
    return paths.longest_paths(tree(spark, d))


@query(_with(_TREE, "roots AS (SELECT DISTINCT src_id FROM tree WHERE src_id NOT IN (SELECT dst_id FROM tree))",
             "w AS (SELECT src_id AS tail, CAST(src_id AS VARCHAR) AS path, CAST(0 AS DOUBLE) AS weight, 0 AS n FROM roots UNION ALL SELECT dst_id, path || '-->' || dst_id, w.weight + tree.weight, n + 1 FROM w JOIN tree ON src_id = tail)", recursive=True)
       + "SELECT path, weight FROM w WHERE n > 0 AND weight = (SELECT max(weight) FROM w WHERE n > 0)")
def longest_weighted(spark, d):
    return paths.longest_weighted_path(tree(spark, d), "weight")


# --- meta-paths


def bazaar(spark: SparkSession, d: str) -> PropertyGraph:
    """Customers, orders and parts as one typed graph; orders are placed, lines contain parts."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customer, orders, part, line = (read_table(spark, d, t) for t in ("customer", "orders", "part", "lineitem"))
    v = customer.select(name("c", "c_custkey").alias("id"), F.lit("customer").alias("vtype"), F.col("c_mktsegment").alias("label"))
    v = v.unionByName(orders.select(name("o", "o_orderkey").alias("id"), F.lit("order").alias("vtype"), F.col("o_orderstatus").alias("label")))
    v = v.unionByName(part.select(name("p", "p_partkey").alias("id"), F.lit("part").alias("vtype"), F.col("p_brand").alias("label")))
    e = orders.select(name("c", "o_custkey").alias("src_id"), name("o", "o_orderkey").alias("dst_id"), F.lit("placed").alias("etype"), F.lit(1.0).alias("quantity"))
    e = e.unionByName(line.select(name("o", "l_orderkey").alias("src_id"), name("p", "l_partkey").alias("dst_id"), F.lit("contains").alias("etype"), F.col("l_quantity").alias("quantity")))
    return PropertyGraph(e, v)


@query("""SELECT 'c' || c_custkey || '-o' || o_orderkey || '-p' || p_partkey AS path FROM customer
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND l_quantity > 40""")
def meta_path(spark, d):
    found = meta_path_search(bazaar(spark, d), ["vertices.vtype = 'customer' AND label = 'BUILDING'", "edges.etype = 'placed'", "vtype = 'order' AND label = 'F'", "etype = 'contains' AND quantity > 40", "vtype = 'part'"], [1, 1])
    return found.select(F.array_join("path", "-").alias("path"))


@query("""SELECT 'p' || p_partkey || '-o' || o_orderkey || '-c' || c_custkey AS path FROM customer
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#11'""")
def meta_path_backward(spark, d):
    found = meta_path_search(bazaar(spark, d), ["vtype = 'part' AND label = 'Brand#11'", "etype = 'contains'", "vtype = 'order'", "etype = 'placed'", "vtype = 'customer'"], [-1, -1])
    return found.select(F.array_join("path", "-").alias("path"))


# --- components, cores, cycles, layers


def _scc_sql(typed: str) -> str:
    return _with(_TRADE, f"g AS (SELECT * FROM trade {typed})", _HUB.replace("trade", "g"),
                 "f AS (SELECT s AS id FROM hub UNION SELECT g.dst_id FROM f JOIN g ON g.src_id = f.id)",
                 "b AS (SELECT s AS id FROM hub UNION SELECT g.src_id FROM b JOIN g ON g.dst_id = b.id)", recursive=True) + "SELECT id FROM f INTERSECT SELECT id FROM b"


@query(_scc_sql(""))
def scc_of_vertex(spark, d):
    g = trade(spark, d)
    return traversal.strongly_connected_component(g, hub(g))


@query(_scc_sql("WHERE etype = 'P'"))
def scc_typed(spark, d):
    g = trade(spark, d).of_type("P")
    return traversal.strongly_connected_component(g, hub(g))


def _wcc_sql(typed: str) -> str:
    return _with(_LINKS, f"p AS (SELECT src_id AS a, dst_id AS b FROM links {typed} UNION SELECT dst_id, src_id FROM links {typed})",
                 "m AS (SELECT a AS id, a AS attr FROM p UNION SELECT p.a, m.attr FROM m JOIN p ON p.b = m.id WHERE m.attr < p.a)", recursive=True) + "SELECT id, min(attr) AS attr FROM m GROUP BY 1"


@query(_wcc_sql(""))
def wcc_global(spark, d):
    return weakly_connected_components(links(spark, d))


@query(_wcc_sql("WHERE edge_type = 3"))
def wcc_typed(spark, d):
    return weakly_connected_components(links(spark, d).of_type(3, "edge_type"))


@query(_with(_LINKS, "h AS (SELECT src_id AS s FROM links GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "p AS (SELECT src_id AS a, dst_id AS b FROM links UNION SELECT dst_id, src_id FROM links)",
             "r AS (SELECT s AS id FROM h UNION SELECT p.b FROM r JOIN p ON p.a = r.id)", recursive=True) + "SELECT id FROM r")
def wcc_of_vertex(spark, d):
    g = links(spark, d)
    return traversal.weakly_connected_component(g, hub(g))


def _core_sql(graph: str, last: str) -> str:
    base = {"trade": _TRADE, "links": _LINKS}["trade" if "trade" in graph else "links"]
    return _with(base, f"g AS (SELECT DISTINCT src_id, dst_id FROM {graph})",
                 "i(n, id) AS (SELECT 0, id FROM (SELECT src_id AS id FROM g UNION SELECT dst_id FROM g) UNION ALL SELECT DISTINCT n + 1, g.dst_id FROM i JOIN g ON g.src_id = i.id WHERE n < 300)",
                 "o(n, id) AS (SELECT 0, id FROM (SELECT src_id AS id FROM g UNION SELECT dst_id FROM g) UNION ALL SELECT DISTINCT n + 1, g.src_id FROM o JOIN g ON g.dst_id = o.id WHERE n < 300)", recursive=True) + last


_IN, _OUT = "SELECT id FROM i WHERE n = 300", "SELECT id FROM o WHERE n = 300"
_CORE = "SELECT id FROM (SELECT id FROM i WHERE n = 300) INTERSECT SELECT id FROM (SELECT id FROM o WHERE n = 300)"


@query(_core_sql("trade", _IN))
def cycle_core_in(spark, d):
    return dag.cycle_detect_in(trade(spark, d))


@query(_core_sql("trade", _OUT))
def cycle_core_out(spark, d):
    return dag.cycle_detect_out(trade(spark, d))


@query(_core_sql("trade", _CORE))
def cycle_core(spark, d):
    return dag.cycle_core(trade(spark, d))


@query(_core_sql("links WHERE edge_type = 4", _CORE))
def cycle_core_typed(spark, d):
    return dag.cycle_core(links(spark, d).of_type(4, "edge_type"))


_C3 = """g AS (SELECT DISTINCT src_id, dst_id, etype FROM trade {t}),
c AS (SELECT src_id || '-' || dst_id AS path, etype AS types FROM g WHERE src_id = dst_id
  UNION ALL SELECT a.src_id || '-' || a.dst_id || '-' || a.src_id, a.etype || '-' || b.etype FROM g a JOIN g b ON a.dst_id = b.src_id AND b.dst_id = a.src_id WHERE a.src_id < a.dst_id
  UNION ALL SELECT a.src_id || '-' || b.src_id || '-' || c.src_id || '-' || a.src_id, a.etype || '-' || b.etype || '-' || c.etype FROM g a JOIN g b ON a.dst_id = b.src_id JOIN g c ON b.dst_id = c.src_id AND c.dst_id = a.src_id
    WHERE a.src_id < b.src_id AND a.src_id < c.src_id AND b.src_id <> c.src_id)"""


@query(_with(_TRADE, _C3.format(t="")) + "SELECT path, types FROM c")
def cycles_enum(spark, d):
    found = dag.cycles(trade(spark, d), max_length=3, edge_type="etype")
    return found.select(_ids_text("path").alias("path"), F.array_join("edges_type", "-").alias("types"))


@query(_with(_TRADE, _C3.format(t="WHERE etype = 'F'")) + "SELECT path FROM c")
def cycles_enum_typed(spark, d):
    return dag.cycles(trade(spark, d).of_type("F"), max_length=3).select(_ids_text("path").alias("path"))


def _ids_text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "-")


def _cycles_from_sql(typed: str) -> str:
    return _with(_TRADE, f"g AS (SELECT src_id, dst_id FROM trade {typed})", _HUB.replace("trade", "g"),
                 """w(path, tail, n) AS (SELECT [src_id, dst_id], dst_id, 1 FROM g, hub WHERE src_id = s
  UNION ALL SELECT list_append(path, g.dst_id), g.dst_id, n + 1 FROM w JOIN g ON g.src_id = tail, hub WHERE n < 4 AND tail <> s AND (g.dst_id = s OR NOT list_contains(path, g.dst_id)))""", recursive=True) + "SELECT array_to_string(path, '-') AS path FROM w, hub WHERE tail = s"  # fmt: skip


@query(_cycles_from_sql(""))
def cycles_from(spark, d):
    """Cycles of at most four edges through the hub, over vertices of the cycle core."""
    g = trade(spark, d)
    return paths.cycles_from(g, hub(g), dag.cycle_core(g), max_length=4).select(_ids_text("path").alias("path"))


@query(_cycles_from_sql("WHERE etype = 'F'"))
def cycles_from_flag(spark, d):
    g = trade(spark, d).of_type("F")
    return paths.cycles_from(g, hub(g), max_length=4).select(_ids_text("path").alias("path"))


@query(_with(_TREE, "w AS (SELECT DISTINCT src_id AS id, 1 AS attr FROM tree UNION SELECT dst_id, attr + 1 FROM w JOIN tree ON src_id = id)", recursive=True) + "SELECT id, max(attr) AS attr FROM w GROUP BY 1")
def topo_rank(spark, d):
    return dag.topo_sorting(tree(spark, d))


@query(_with(_TREE, "t AS (SELECT * FROM tree WHERE etype = 'customer')") + "SELECT DISTINCT src_id AS id, 1 AS attr FROM t UNION ALL SELECT dst_id, 2 FROM t")
def topo_typed(spark, d):
    return dag.topo_sorting(tree(spark, d).of_type("customer"))


# --- ranks, triangles, shortest paths


def _rank_sql(k: int) -> str:
    steps = ["""v AS (SELECT src_id AS id FROM trade UNION SELECT dst_id FROM trade)""", "n AS (SELECT count(*) AS n FROM v)", "deg AS (SELECT src_id, count(*) AS d FROM trade GROUP BY 1)",
             "r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM v, n)"]
    for i in range(k):
        steps.append(f"""s{i} AS (SELECT t.dst_id AS id, sum(r.r / d.d) AS s FROM trade t JOIN r{i} r ON r.id = t.src_id JOIN deg d ON d.src_id = t.src_id GROUP BY 1),
r{i + 1} AS (SELECT r.id, CASE WHEN s.s IS NULL THEN r.r ELSE 0.85 * s.s + 0.15 / n END AS r FROM r{i} r LEFT JOIN s{i} s ON s.id = r.id, n)""")
    return _with(_TRADE, *steps) + f"SELECT id, round(r, 10) AS attr FROM r{k}"


@query(_rank_sql(5))
def pagerank_k(spark, d):
    """Five iterations."""
    return rank.pagerank(trade(spark, d), 0.15, None, 5).select("id", F.round("attr", 10).alias("attr"))


@query()
def pagerank_converged(spark, d):
    return rank.pagerank(trade(spark, d), 0.15, 1e-5, 50)


def _triangle_sql(typed: str) -> str:
    return _with(_TRADE, f"p AS (SELECT DISTINCT least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b FROM trade WHERE src_id <> dst_id {typed})",
                 "t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM p x JOIN p y ON y.a = x.b JOIN p z ON z.a = x.a AND z.b = y.b)") + "SELECT id, CAST(count(*) AS BIGINT) AS attr FROM (SELECT i AS id FROM t UNION ALL SELECT j FROM t UNION ALL SELECT k FROM t) GROUP BY 1"


@query(_triangle_sql(""))
def triangles_all(spark, d):
    return triangles.triangle_count(trade(spark, d))


@query(_triangle_sql("AND etype = 'O'"))
def triangles_typed(spark, d):
    return triangles.triangle_count(trade(spark, d).of_type("O"))


@query(_triangle_sql(""))
def triangles_intersect(spark, d):
    return triangles.triangle_count_by_intersection(trade(spark, d))


@query(_with(_TRADE, "o AS (SELECT DISTINCT src_id AS id, dst_id AS x FROM trade)", "i AS (SELECT DISTINCT dst_id AS id, src_id AS x FROM trade)", "k AS (SELECT id FROM o INTERSECT SELECT id FROM i)")
       + "SELECT k.id, CAST((SELECT count(*) FROM o JOIN i USING (id, x) WHERE o.id = k.id) AS INT) AS attr FROM k")
def intersection_count(spark, d):
    """How many vertices are successor and predecessor of a vertex."""
    e = trade(spark, d).links()
    outs, ins = e.groupBy(F.col("src_id").alias("id")).agg(F.collect_set("dst_id").alias("o")), e.groupBy(F.col("dst_id").alias("id")).agg(F.collect_set("src_id").alias("i"))
    return outs.join(ins, "id").select("id", triangles.intersection_count(F.col("o"), F.col("i")).alias("attr"))


_FARTHEST = "SELECT id AS t, hop AS far FROM l ORDER BY hop DESC, id LIMIT 1"
_QUIETEST = "SELECT t, hop AS far FROM (SELECT dst_id AS t FROM e GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) JOIN l ON l.id = t"


def _shortest_sql(typed: str, cols: str, goal: str, k: int = 8) -> str:
    return _with(_TRADE, f"g AS (SELECT DISTINCT src_id, dst_id, {'etype' if 'types' in cols else '1 AS etype'} FROM trade {typed})", f"e AS (SELECT * FROM trade {typed})", _HUB.replace("trade", "e"),
                 f"r(id, hop) AS (SELECT s, 0 FROM hub UNION SELECT g.dst_id, hop + 1 FROM r JOIN g ON g.src_id = r.id WHERE hop < {k})", "l AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1)",
                 f"goal AS ({goal})",
                 """w(path, types, tail, n) AS (SELECT [s], CAST([] AS VARCHAR[]), s, 0 FROM hub
  UNION ALL SELECT list_append(path, g.dst_id), list_append(types, CAST(g.etype AS VARCHAR)), g.dst_id, n + 1 FROM w JOIN g ON g.src_id = tail JOIN l ON l.id = g.dst_id AND l.hop = n + 1 WHERE n < (SELECT far FROM goal))""", recursive=True) + f"SELECT {cols} FROM w, goal WHERE tail = t"  # fmt: skip


def _far(g: PropertyGraph, source):
    """The vertex farthest from the source, ties by the smallest id."""
    return shortest.distances(g, source, 8).orderBy(F.desc("hop"), "id").first()["id"]


def _quietest(g: PropertyGraph):
    """The vertex with fewest in-edges, ties by the smallest id."""
    return g.edges.groupBy("dst_id").count().orderBy("count", "dst_id").first()["dst_id"]


@query(_shortest_sql("", "array_to_string(path, '-') AS path", _QUIETEST))
def shortest_paths(spark, d):
    g = trade(spark, d)
    s = hub(g)
    return shortest.shortest_path(g, s, _quietest(g), 8).select(_ids_text("path").alias("path"))


@query(_shortest_sql("WHERE etype = 'P'", "array_to_string(path, '-') AS path", _FARTHEST))
def shortest_typed(spark, d):
    g = trade(spark, d).of_type("P")
    s = hub(g)
    return shortest.shortest_path(g, s, _far(g, s), 8).select(_ids_text("path").alias("path"))


@query(_shortest_sql("", "array_to_string(path, '-') AS path, array_to_string(types, '-') AS types", _QUIETEST))
def shortest_with_types(spark, d):
    g = trade(spark, d)
    s = hub(g)
    return shortest.shortest_path(g, s, _quietest(g), 8, edge_type="etype").select(_ids_text("path").alias("path"), F.array_join("edges_type", "-").alias("types"))


_WEIGHTED = """w(path, tail, total, n) AS (SELECT [s], s, CAST(0 AS BIGINT), 0 FROM hub
  UNION ALL SELECT list_append(path, g.dst_id), g.dst_id, total + g.weight, n + 1 FROM w JOIN g ON g.src_id = tail, hub, goal WHERE n < 4 AND tail <> t AND g.dst_id <> s)"""


@query(_with(_TRADE, "g AS (SELECT src_id, dst_id, min(weight) AS weight FROM trade WHERE etype = 'P' GROUP BY 1, 2)", "e AS (SELECT * FROM trade WHERE etype = 'P')", _HUB.replace("trade", "e"),
             "r(id, hop) AS (SELECT s, 0 FROM hub UNION SELECT g.dst_id, hop + 1 FROM r JOIN g ON g.src_id = r.id WHERE hop < 3)", "l AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1)",
             "goal AS (SELECT id AS t FROM l ORDER BY hop DESC, id LIMIT 1)", _WEIGHTED, recursive=True)
       + "SELECT array_to_string(path, '-') AS path, CAST(total AS DOUBLE) AS total FROM w, goal WHERE tail = t AND total = (SELECT min(total) FROM w, goal WHERE tail = t)")
def shortest_weighted(spark, d):
    g = trade(spark, d).of_type("P")
    s = hub(g)
    goal = shortest.distances(g, s, 3).orderBy(F.desc("hop"), "id").first()["id"]
    return shortest.shortest_weighted_path(g, s, goal, 4, "weight").select(_ids_text("path").alias("path"), "total")


# --- lookups


@query("SELECT p_partkey AS vid, p_brand, p_size FROM part WHERE p_partkey IN (3, 5, 8, 13, 21, 34, 55, 89, 144)")
def lookup_vertices_parts(spark, d):
    got = lookup_vertices(read_table(spark, d, "part").withColumnRenamed("p_partkey", "vid"), [3, 5, 8, 13, 21, 34, 55, 89, 144, 10**12], ["p_brand", "p_size"])
    return got.select("vid", F.get_json_object("attrs", "$.p_brand").alias("p_brand"), F.get_json_object("attrs", "$.p_size").cast("int").alias("p_size"))


@query(_with(_TRADE, _HUB) + "SELECT src_id, dst_id, etype, weight FROM trade WHERE src_id = (SELECT s FROM hub)")
def lookup_edges_trade(spark, d):
    g = trade(spark, d)
    pairs = g.edges.filter(F.col("src_id") == hub(g)).select("src_id", "dst_id").distinct()
    got = lookup_edges(g.edges, pairs, None, ["etype", "weight"])
    return got.select("src_id", "dst_id", F.get_json_object("attrs", "$.etype").alias("etype"), F.get_json_object("attrs", "$.weight").cast("bigint").alias("weight"))


# --- communities


@query()
def louvain_trade(spark, d):
    return community.louvain(trade(spark, d), max_iter=3, max_iter_stage1=8)


@query(_with(_TRADE) + "SELECT a, b, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT DISTINCT least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b, weight AS w FROM trade) GROUP BY 1, 2")
def canonical_edges(spark, d):
    return community.canonical_edges(trade(spark, d), "weight", dedupe=True)


_PARTS = "a AS (SELECT c_custkey AS vid, c_nationkey AS cid FROM customer), b AS (SELECT c_custkey AS vid, c_mktsegment AS cid FROM customer)"


@query(_with(_TRADE, _PARTS, "e AS (SELECT x.cid AS ca, y.cid AS cb FROM trade JOIN a x ON x.vid = src_id JOIN a y ON y.vid = dst_id)", "m AS (SELECT count(*)::DOUBLE AS m FROM e)",
             "d AS (SELECT c, count(*)::DOUBLE AS k FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY 1)")
       + "SELECT round((SELECT count(*) FROM e WHERE ca = cb) / (SELECT m FROM m) - (SELECT sum(k * k) FROM d) / (4 * (SELECT m * m FROM m)), 10) AS modularity")
def modularity_by_nation(spark, d):
    members = read_table(spark, d, "customer").select(F.col("c_custkey").alias("vid"), F.col("c_nationkey").alias("cid"))
    return community.modularity(community.canonical_edges(trade(spark, d)), members).select(F.round("modularity", 10).alias("modularity"))


_TABLE = _PARTS + ", t AS (SELECT a.cid AS ca, b.cid AS cb, count(*)::DOUBLE AS n FROM a JOIN b USING (vid) GROUP BY 1, 2), ra AS (SELECT ca, sum(n) AS na FROM t GROUP BY 1), rb AS (SELECT cb, sum(n) AS nb FROM t GROUP BY 1), z AS (SELECT sum(n) AS t FROM t)"


def _partitions(spark, d):
    c = read_table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("vid"), F.col("c_nationkey").alias("cid")), c.select(F.col("c_custkey").alias("vid"), F.col("c_mktsegment").alias("cid"))


@query(_with(_TABLE) + """SELECT round(2 * (SELECT sum(n / z.t * ln(n * z.t / (na * nb))) FROM t JOIN ra USING (ca) JOIN rb USING (cb), z)
 / ((SELECT -sum(na / z.t * ln(na / z.t)) FROM ra, z) + (SELECT -sum(nb / z.t * ln(nb / z.t)) FROM rb, z)), 10) AS nmi""")
def nmi_of_partitions(spark, d):
    return community.nmi(*_partitions(spark, d)).select(F.round("nmi", 10).alias("nmi"))


@query(_with(_TABLE, "s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(na * (na - 1) / 2) FROM ra) AS sa, (SELECT sum(nb * (nb - 1) / 2) FROM rb) AS sb, (SELECT t * (t - 1) / 2 FROM z) AS p)") + "SELECT round((s - sa * sb / p) / ((sa + sb) / 2 - sa * sb / p), 10) AS ari FROM s")
def ari_of_partitions(spark, d):
    return community.ari(*_partitions(spark, d)).select(F.round("ari", 10).alias("ari"))


@query("SELECT c_custkey AS vid, (48271 * c_custkey) % 255 AS attr FROM customer")
def next_random(spark, d):
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("vid"), community.next_random(F.col("c_custkey")).alias("attr"))


@query("SELECT c_custkey AS vid, CAST(coalesce(list_position([1, 4, 9, 16], c_nationkey), 0) AS BIGINT) AS attr FROM customer")
def index_of(spark, d):
    """Place of a value in a list, 0 if it is not there."""
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("vid"), paths.index_of(F.array(*map(F.lit, (1, 4, 9, 16))), F.col("c_nationkey")).cast("bigint").alias("attr"))
