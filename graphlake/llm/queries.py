"""Queries of the training-data operators over the test tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions.ids import numeric_id
from graphlake.llm.contamination import cut_leaks, leak_spans, leaked_items
from graphlake.llm.format_copies import format_copies, record_counts
from graphlake.llm.match_groups import match_groups
from graphlake.llm.mixing import default_vocabulary, mix, mixture_shares, shuffled_shards, token_counts
from graphlake.llm.spam import spam_pages, spam_scores
from graphlake.storage import read_table

SAME_RECORD = 2


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vertices linked by 'same record' edges and 'match' edges, directly or through others."""
    edges = read_table(spark, sf_dir, "edges").filter(F.col("edge_type") == SAME_RECORD).select("src_id", "dst_id")
    g_oe = read_table(spark, sf_dir, "g_oe").filter(F.col("etype") == "match").select(numeric_id(F.col("owner_vertex")).alias("src_id"), numeric_id(F.col("other_vertex")).alias("dst_id"))
    return match_groups([edges, g_oe])


def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vertices each group has."""
    return p1_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_vertices"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest line of each record of louvain_edges with each further line."""
    return format_copies(read_table(spark, sf_dir, "louvain_edges"))


def p2_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each record has."""
    lines = read_table(spark, sf_dir, "louvain_edges")
    return record_counts(lines, format_copies(lines))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with at least 14 consecutive words of a test item, and the item."""
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of pages that leak, by their characters."""
    return leak_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id", "start", "end")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages without what leaks: characters cut and share of leaked words; pages that are mostly leaks are gone."""
    kept = cut_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return kept.select("doc_id", F.length("text").alias("n_chars"), "n_cut", "coverage")


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read_table(spark, sf_dir, "documents"), default_vocabulary(spark))
    return mix(counts, read_table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn pages, shard by shard in their shuffled order."""
    return shuffled_shards(_mixture(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixture_shares(_mixture(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of repeated keywords, links or product tags."""
    return spam_pages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), prose_lang="lang")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of spam and mean surprisal of every page."""
    return spam_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), prose_lang="lang")


QUERIES = {q.__name__: q for q in (p1_found, p1_group_sizes, p2_found, p2_copy_counts, p6_found, p6_spans, p6_clean, p7_selection, p7_shares, p8_found, p8_scores)}

_ID = "try_cast(regexp_extract({0}, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS BIGINT)"

_GROUPS = f"""
pairs AS (
  SELECT src_id AS a, dst_id AS b FROM edges WHERE edge_type = 2 AND src_id IS NOT NULL AND dst_id IS NOT NULL
  UNION SELECT a, b FROM (SELECT {_ID.format("owner_vertex")} AS a, {_ID.format("other_vertex")} AS b FROM g_oe WHERE etype = 'match') WHERE a IS NOT NULL AND b IS NOT NULL),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
least AS (SELECT a AS vid, a AS m FROM links UNION SELECT l.a, r.m FROM least r JOIN links l ON l.b = r.vid WHERE r.m < l.a),
grouped AS (SELECT min(m) AS group_id, vid FROM least GROUP BY vid)"""

_FIELD = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_NUM = r"CAST(replace(regexp_extract({0}, '[+]?[0-9]*[.,]?[0-9]+'), ',', '.') AS DECIMAL(30,12))"
_F = [_FIELD.format(c) for c in ("src_id", "dst_id", "weight")]
_COPIES = f"""
l AS (SELECT line_id, {_F[0]} AS a, {_F[1]} AS b, {_F[2]} AS c, src_id, dst_id, weight FROM louvain_edges),
d AS (SELECT *, CAST(regexp_matches(a, '^[0-9]') AS INT) AS da, CAST(regexp_matches(b, '^[0-9]') AS INT) AS db, CAST(regexp_matches(c, '^[0-9]') AS INT) AS dc
      FROM l WHERE a <> '' AND b <> '' AND c <> ''),
r AS (SELECT line_id, CASE WHEN da = 1 THEN b ELSE a END AS x, CASE WHEN dc = 1 THEN b ELSE c END AS y,
             CASE WHEN da = 1 THEN {_NUM.format("src_id")} WHEN db = 1 THEN {_NUM.format("dst_id")} ELSE {_NUM.format("weight")} END AS w
      FROM d WHERE da + db + dc = 1),
k AS (SELECT line_id, min(line_id) OVER (PARTITION BY least(x, y), greatest(x, y), w) AS head FROM r)"""

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_GROUPS} SELECT group_id, vid FROM grouped",
    "p1_group_sizes": f"WITH RECURSIVE {_GROUPS} SELECT group_id, CAST(count(*) AS BIGINT) AS n_vertices FROM grouped GROUP BY 1",
    "p2_found": f"WITH {_COPIES} SELECT head AS line_id_a, line_id AS line_id_b FROM k WHERE line_id <> head",
    "p2_copy_counts": f"WITH {_COPIES} SELECT head AS line_id, CAST(count(*) AS BIGINT) AS n_copies FROM k GROUP BY 1",
}
