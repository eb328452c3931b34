"""Queries of the general data problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions.ids import numeric_id
from graphlake.operators.hierarchy import descendants, hierarchy, other_parents
from graphlake.operators.orphans import Hierarchy, orphan_cascade, orphan_report
from graphlake.operators.skew import KeyColumn, heavy_keys, key_stats, key_totals
from graphlake.storage import read_table

PARENT_TO_CHILD = 3


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = read_table(spark, sf_dir, "edges"), read_table(spark, sf_dir, "vertices")
    return orphan_cascade(
        edges, F.col("eid"), ["src_id", "dst_id"], F.col("created_at"),
        vertices, F.col("vid"), F.col("created_at"), F.col("deleted_at"),
        Hierarchy(provides=F.col("dst_id"), depends=F.col("src_id"), endpoint="src_id", member=F.col("edge_type") == PARENT_TO_CHILD),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of edges to vertices that did not exist at the time."""
    return _cascade(spark, sf_dir).filter(F.col("kind") == "direct").select(F.col("row_key").alias("eid"), "endpoint", F.date_format("at", "yyyy-MM").alias("period"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans of edges per end and month."""
    return orphan_report(_cascade(spark, sf_dir), "edges")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "edges").filter(F.col("edge_type") == PARENT_TO_CHILD)
    return hierarchy(edges, F.col("src_id"), F.col("dst_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and path of each vertex of the hierarchy edges."""
    return _tree(spark, sf_dir).select("vid", "root_vid", "depth", "path")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of descendants of each vertex outside cycles, from nested-set ranges."""
    tree = _tree(spark, sf_dir)
    return tree.filter(F.col("root_vid") != -1).select("vid", (F.col("rgt") - F.col("lft")).alias("n_descendants"))


def p4_root_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every root."""
    tree = _tree(spark, sf_dir)
    return descendants(tree, tree.filter(F.col("depth") == 0).select("vid"))


def p4_other_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to a parent that is not the smallest of its child, which the hierarchy does not follow."""
    edges = read_table(spark, sf_dir, "edges").filter(F.col("edge_type") == PARENT_TO_CHILD)
    return other_parents(edges, F.col("src_id"), F.col("dst_id"), hierarchy(edges, F.col("src_id"), F.col("dst_id")))


def p4_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every vertex outside cycles, with the levels between."""
    return descendants(_tree(spark, sf_dir))


def _key_columns(spark: SparkSession, sf_dir: str) -> list[KeyColumn]:
    edges, g_ie = read_table(spark, sf_dir, "edges"), read_table(spark, sf_dir, "g_ie")
    return [
        KeyColumn("edges", "src_id", edges, F.col("src_id"), F.col("dst_id")),
        KeyColumn("edges", "dst_id", edges, F.col("dst_id"), F.col("src_id")),
        KeyColumn("g_ie", "owner_vertex", g_ie, numeric_id(F.col("owner_vertex")), numeric_id(F.col("other_vertex"))),
    ]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices that own at least a hundredth of the rows of a table."""
    columns = _key_columns(spark, sf_dir)
    return heavy_keys(key_stats(columns), totals=key_totals(columns)).select("table_name", "column_name", "vid")


def p5_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and different neighbours of every vertex in every key column."""
    return key_stats(_key_columns(spark, sf_dir)).filter(F.col("vid").isNotNull())


QUERIES = {q.__name__: q for q in (p3_found, p3_report, p4_found, p4_descendants, p4_root_members, p4_other_parents, p4_all_descendants, p5_found, p5_key_stats)}

_ID = "try_cast(regexp_extract({0}, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS BIGINT)"

_P3_DIRECT = """
ends AS (
  SELECT eid, 'src_id' AS endpoint, src_id AS ref, created_at, edge_type, src_id, dst_id FROM edges WHERE src_id IS NOT NULL
  UNION ALL SELECT eid, 'dst_id', dst_id, created_at, edge_type, src_id, dst_id FROM edges WHERE dst_id IS NOT NULL),
direct AS (
  SELECT DISTINCT e.eid, e.endpoint, e.created_at, e.edge_type, e.src_id, e.dst_id FROM ends e
  WHERE NOT EXISTS (SELECT 1 FROM vertices v WHERE v.vid = e.ref AND v.created_at <= e.created_at
                    AND (v.deleted_at IS NULL OR v.deleted_at > e.created_at)))"""

_TREE = """
links AS (SELECT DISTINCT src_id AS p, dst_id AS v FROM edges WHERE edge_type = 3 AND src_id IS NOT NULL AND dst_id IS NOT NULL),
nodes AS (SELECT p AS v FROM links UNION SELECT v FROM links),
walk AS (
  SELECT v, v AS root, CAST(0 AS BIGINT) AS depth, CAST(v AS VARCHAR) AS path FROM nodes WHERE v NOT IN (SELECT v FROM links)
  UNION ALL SELECT l.v, w.root, w.depth + 1, w.path || '/' || CAST(l.v AS VARCHAR) FROM walk w JOIN links l ON l.p = w.v)"""

ORACLES = {
    "p3_found": f"WITH {_P3_DIRECT} SELECT DISTINCT eid, endpoint, strftime(created_at, '%Y-%m') AS period FROM direct",
    "p3_report": f"""WITH RECURSIVE {_P3_DIRECT},
rec AS (
  SELECT DISTINCT dst_id AS k FROM direct WHERE edge_type = 3 AND src_id IS NOT NULL AND dst_id IS NOT NULL
  UNION SELECT e.dst_id FROM rec r JOIN edges e ON e.src_id = r.k WHERE e.edge_type = 3 AND e.dst_id IS NOT NULL),
inherited AS (
  SELECT DISTINCT e.eid, 'src_id' AS endpoint, e.created_at FROM edges e WHERE e.edge_type = 3 AND e.src_id IN (SELECT k FROM rec)
  AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.eid = e.eid AND d.endpoint = 'src_id'))
SELECT 'edges' AS table_name, endpoint, strftime(created_at, '%Y-%m') AS period, kind, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT DISTINCT eid, endpoint, created_at, 'direct' AS kind FROM direct
  UNION ALL SELECT eid, endpoint, created_at, 'inherited' FROM inherited) GROUP BY ALL""",
    "p4_found": f"""WITH RECURSIVE {_TREE}
SELECT n.v AS vid, coalesce(w.root, -1) AS root_vid, coalesce(w.depth, -1) AS depth, coalesce(w.path, '') AS path FROM nodes n LEFT JOIN walk w ON w.v = n.v""",
    "p4_descendants": f"""WITH RECURSIVE {_TREE}
SELECT a AS vid, CAST(count(*) - 1 AS BIGINT) AS n_descendants FROM (SELECT CAST(unnest(string_split(path, '/')) AS BIGINT) AS a FROM walk) GROUP BY 1""",
    "p4_root_members": f"WITH RECURSIVE {_TREE} SELECT root AS vid, v AS descendant_vid, depth AS levels FROM walk WHERE depth > 0",
    "p4_other_parents": f"WITH RECURSIVE {_TREE} SELECT v AS vid, p AS parent_vid FROM links QUALIFY p <> min(p) OVER (PARTITION BY v)",
    "p4_all_descendants": f"""WITH RECURSIVE {_TREE},
pairs AS (
  SELECT p AS vid, v AS descendant_vid, CAST(1 AS BIGINT) AS levels FROM links WHERE v IN (SELECT v FROM walk)
  UNION ALL SELECT a.vid, l.v, a.levels + 1 FROM pairs a JOIN links l ON l.p = a.descendant_vid)
SELECT vid, descendant_vid, levels FROM pairs""",
    "p5_key_stats": f"""SELECT table_name, column_name, vid, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT nbr) AS BIGINT) AS n_neighbours FROM (
  SELECT 'edges' AS table_name, 'src_id' AS column_name, src_id AS vid, dst_id AS nbr FROM edges
  UNION ALL SELECT 'edges', 'dst_id', dst_id, src_id FROM edges
  UNION ALL SELECT 'g_ie', 'owner_vertex', {_ID.format("owner_vertex")}, {_ID.format("other_vertex")} FROM g_ie)
WHERE vid IS NOT NULL GROUP BY ALL""",
    "p5_found": f"""SELECT 'edges' AS table_name, 'src_id' AS column_name, src_id AS vid FROM edges WHERE src_id IS NOT NULL GROUP BY 3 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)
UNION ALL SELECT 'edges', 'dst_id', dst_id FROM edges WHERE dst_id IS NOT NULL GROUP BY 3 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)
UNION ALL SELECT 'g_ie', 'owner_vertex', vid FROM (SELECT {_ID.format("owner_vertex")} AS vid FROM g_ie) WHERE vid IS NOT NULL GROUP BY 3 HAVING count(*) >= 0.01 * (SELECT count(*) FROM g_ie)""",
}
