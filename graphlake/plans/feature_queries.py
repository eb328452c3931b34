"""Feature engineering and sampling queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlake.functions import features
from graphlake.ml import sampling
from graphlake.operators.graph import PropertyGraph
from graphlake.plans.graph_queries import _TRADE, _with, bazaar, trade
from graphlake.storage import read_table

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


@query("SELECT p_brand AS value FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def most_common(spark, d):
    return features.most_common(read_table(spark, d, "part"), "p_brand")


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank, p_brand AS value, count(*) AS freq FROM part GROUP BY p_brand QUALIFY rank <= 5")
def top_n(spark, d):
    return features.top_n(read_table(spark, d, "part"), "p_brand", 5)


_TOP_PERCENT = """f AS (SELECT {c} AS value, count(*) AS freq FROM {t} GROUP BY 1), s AS (SELECT *, row_number() OVER w AS rank, sum(freq) OVER w - freq AS before, sum(freq) OVER () AS total FROM f
  WINDOW w AS (ORDER BY freq DESC, value NULLS LAST ROWS UNBOUNDED PRECEDING))"""


@query(_with(_TOP_PERCENT.format(c="p_type", t="part").replace("sum(freq) OVER ()", "(SELECT sum(freq) FROM f)")) + "SELECT rank, value, freq FROM s WHERE before <= total * 0.7")
def top_percent(spark, d):
    return features.top_percent(read_table(spark, d, "part"), "p_type", 0.7)


@query("SELECT eid, coalesce(CASE WHEN edge_weight >= 3 THEN 1 WHEN edge_weight < 3 THEN 0 END, -1) AS heavy FROM edges")
def binarize(spark, d):
    e = read_table(spark, d, "edges")
    return e.select("eid", F.coalesce(features.binarize(F.col("edge_weight"), 3, 1, 0), F.lit(-1)).alias("heavy"))


@query("SELECT eid, coalesce(CASE WHEN edge_type IS NULL THEN NULL ELSE (edge_type = 1)::INT || '' || (edge_type = 2)::INT || (edge_type = 4)::INT END, '') AS hot FROM edges")
def onehot(spark, d):
    hot = features.onehot_encode(F.col("edge_type"), [1, 2, 4])
    return read_table(spark, d, "edges").select("eid", F.coalesce(F.array_join(hot.cast("array<string>"), ""), F.lit("")).alias("hot"))


@query("SELECT eid, coalesce(CASE WHEN edge_type IS NULL THEN NULL ELSE (edge_type = 1)::INT || '' || (edge_type = 2)::INT || (edge_type NOT IN (1, 2))::INT END, '') AS hot FROM edges")
def onehot_others(spark, d):
    hot = features.onehot_encode(F.col("edge_type"), [1, 2], with_others=True)
    return read_table(spark, d, "edges").select("eid", F.coalesce(F.array_join(hot.cast("array<string>"), ""), F.lit("")).alias("hot"))


@query("SELECT eid, coalesce(CASE WHEN edge_type IS NULL THEN NULL ELSE (edge_type = 1)::INT || '' || (edge_type = 2)::INT || (edge_type = 3)::INT || (edge_type > 3)::INT END, '') AS hot FROM edges")
def onehot_ids(spark, d):
    hot = features.onehot_ids(F.col("edge_type"), 3, with_others=True)
    return read_table(spark, d, "edges").select("eid", F.coalesce(F.array_join(hot.cast("array<string>"), ""), F.lit("")).alias("hot"))


@query(_with(_TOP_PERCENT.format(c="event_type", t="events").replace("sum(freq) OVER ()", "(SELECT sum(freq) FROM f)"), "e AS (SELECT value FROM s WHERE rank <= 2)")
       + "SELECT event_id, array_to_string([CAST(event_type = v AS INT) FOR v IN (SELECT list(value ORDER BY rank) FROM s WHERE rank <= 2)], '') || CAST(event_type NOT IN (SELECT value FROM e) AS INT) AS hot FROM events")
def onehot_top(spark, d):
    """One-hot codes of the two most frequent event types and all others."""
    e = read_table(spark, d, "events")
    hot = features.onehot_encode(F.col("event_type"), features.top_n_values(e, "event_type", 2), with_others=True)
    return e.select("event_id", F.array_join(hot.cast("array<string>"), "").alias("hot"))


def _impute(how: str, value: str):
    sql = f"SELECT eid, round(coalesce(edge_weight, {value}), 8) AS edge_weight FROM edges" if how != "drop" else "SELECT eid, round(edge_weight, 8) AS edge_weight FROM edges WHERE edge_weight IS NOT NULL"

    def f(spark, d):
        e = read_table(spark, d, "edges").select("eid", "edge_weight")
        return features.impute(e, "edge_weight", how, 1.5).select("eid", F.round("edge_weight", 8).alias("edge_weight"))

    f.__name__, f.__doc__ = f"impute_{how}", f"Edge weights with nulls replaced: {how}."
    query(sql)(f)


for _how, _value in {
    "drop": "",
    "constant": "1.5",
    "mode": "(SELECT edge_weight FROM edges WHERE edge_weight IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "max": "(SELECT max(edge_weight) FROM edges)",
    "min": "(SELECT min(edge_weight) FROM edges)",
    "avg": "(SELECT avg(edge_weight) FROM edges)",
    "median": "(SELECT median(edge_weight) FROM edges)",
}.items():
    _impute(_how, _value)


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 8) AS c_acctbal FROM customer")
def standardize(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return features.standardize(c, "c_acctbal").select("c_custkey", F.round("c_acctbal", 8).alias("c_acctbal"))


@query("SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 10) AS o_totalprice FROM orders")
def l1_norm(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return features.l1_normalize(o, "o_totalprice").select("o_orderkey", F.round("o_totalprice", 10).alias("o_totalprice"))


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)), 8) AS p_retailprice FROM part")
def minmax(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_retailprice")
    return features.minmax(p, "p_retailprice").select("p_partkey", F.round("p_retailprice", 8).alias("p_retailprice"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) + l_tax, 6) AS net, CAST(l_orderkey % 7 AS BIGINT) AS m,
  round(power(l_quantity, 2), 6) AS sq, round(exp(l_discount), 8) AS e, round(ln(l_extendedprice), 8) AS lg, round(log10(l_quantity), 8) AS l10 FROM lineitem""")
def feature_math(spark, d):
    x = read_table(spark, d, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"), 6).alias("net"), (F.col("l_orderkey") % 7).alias("m"),
        F.round(F.pow("l_quantity", F.lit(2.0)), 6).alias("sq"), F.round(F.exp("l_discount"), 8).alias("e"), F.round(F.ln("l_extendedprice"), 8).alias("lg"), F.round(F.log10("l_quantity"), 8).alias("l10"),
    )


# --- sampling for graph learning


@query(_with(_TRADE) + "SELECT src_id, dst_id, eid, CAST(rk AS INT) AS rank FROM (SELECT src_id, dst_id, eid, row_number() OVER (PARTITION BY src_id ORDER BY weight DESC, dst_id, eid) AS rk FROM trade) WHERE rk <= 3")
def sample_topk_neighbours(spark, d):
    return sampling.top_neighbours(trade(spark, d), 3, "weight", ties=["dst_id", "eid"]).select("src_id", "dst_id", "eid", "rank")


@query("""WITH a AS (SELECT 'c' || o_custkey AS seed, 'o' || o_orderkey AS h1 FROM orders), b AS (SELECT 'o' || l_orderkey AS h1, 'p' || l_partkey AS h2 FROM lineitem)
SELECT seed, CAST(count(*) AS BIGINT) AS n_paths, CAST(count(DISTINCT h1) AS BIGINT) AS n_first, CAST(count(DISTINCT h2) AS BIGINT) AS n_second FROM a JOIN b USING (h1) GROUP BY 1""")
def typed_receptive_field(spark, d):
    """Sizes of the fields of customers over orders to parts."""
    g = bazaar(spark, d)
    g = PropertyGraph(g.edges.withColumn("et", F.when(F.col("etype") == "placed", 1).otherwise(2)), g.vertices.withColumn("vt", F.when(F.col("vtype") == "customer", 1).when(F.col("vtype") == "order", 2).otherwise(3)))
    field = sampling.receptive_field(g, "(1)-[1]->(2)-[2]->(3)", vertex_type="vt", edge_type="et")
    return field.groupBy("seed").agg(F.count(F.lit(1)).alias("n_paths"), F.countDistinct("hop1").alias("n_first"), F.countDistinct("hop2").alias("n_second"))


@query("""WITH w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT a.event_type AS target, b.event_type AS context, CAST(count(*) AS BIGINT) AS n FROM w a JOIN w b ON a.user_id = b.user_id AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY 1, 2""")
def skipgram_pairs(spark, d):
    """Pairs of event types at most two apart in the sequence of a user."""
    seq = read_table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("walk"))
    return sampling.skipgram_pairs(seq, "walk", 2).groupBy("target", "context").agg(F.count(F.lit(1)).alias("n"))


def _drawn(g, drawn) -> DataFrame:
    """How many neighbours each source has drawn, how many different ones, and how many of them are its neighbours."""
    pairs = g.links().distinct().withColumn("edge", F.lit(1))
    met = drawn.join(pairs, ["src_id", "dst_id"], "left")
    return met.groupBy("src_id").agg(F.count(F.lit(1)).alias("n_drawn"), F.max("rank").cast("bigint").alias("last_rank"), F.count("edge").alias("n_edges"))


_DRAWN = "SELECT src_id, least(3, count(*)) AS n_drawn, least(3, count(*)) AS last_rank, least(3, count(*)) AS n_edges FROM trade"


@query(f"WITH {_TRADE} {_DRAWN} GROUP BY 1")
def sample_random_neighbours(spark, d):
    """Three edges of each vertex, all if there are fewer, none of them made up."""
    return _drawn(trade(spark, d), sampling.random_neighbours(trade(spark, d), 3, seed=7))


@query(f"WITH {_TRADE} {_DRAWN} WHERE weight > 0 GROUP BY 1")
def sample_weighted_neighbours(spark, d):
    """The same by weight."""
    return _drawn(trade(spark, d), sampling.random_neighbours(trade(spark, d), 3, seed=7, weight="weight"))


@query("SELECT CAST(0 AS BIGINT) AS n_edges, CAST(0 AS BIGINT) AS n_self, true AS two_at_most, true AS most_are_kept")
def negative_samples(spark, d):
    """Drawn strangers are never neighbours nor the vertex itself, and of two draws a vertex nearly all are kept."""
    g = trade(spark, d)
    drawn = sampling.negative_samples(g, 2, seed=7, by_in_degree=True)
    met = drawn.join(g.links().select("src_id", F.col("dst_id").alias("neg_id")).distinct().withColumn("edge", F.lit(1)), ["src_id", "neg_id"], "left")
    each = met.groupBy("src_id").agg(F.count(F.lit(1)).alias("n"), F.count("edge").alias("e"), F.count_if(F.col("src_id") == F.col("neg_id")).alias("s"))
    sources = g.links().agg(F.countDistinct("src_id").alias("k"))
    return each.agg(F.sum("e").alias("n_edges"), F.sum("s").alias("n_self"), (F.max("n") <= 2).alias("two_at_most"), F.sum("n").alias("all")).crossJoin(sources).select("n_edges", "n_self", "two_at_most", (F.col("all") > 1.8 * F.col("k")).alias("most_are_kept"))


@query(f"WITH {_TRADE}, ids AS (SELECT src_id AS start FROM trade UNION SELECT dst_id FROM trade) SELECT start, CAST(0 AS BIGINT) AS off_graph, true AS as_long_as_it_can FROM ids")
def random_walks(spark, d):
    """A walk from every vertex: steps that are no edges, and whether it has five steps or ends where no edge leaves."""
    g = trade(spark, d)
    walks = sampling.random_walks(g, length=5, seed=7, weight="weight").select("walk", F.element_at("walk", 1).alias("start"))
    pairs = g.links().distinct().withColumn("edge", F.lit(1))
    steps = walks.select("start", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"), "walk").filter(F.col("i") < F.size("walk")).select("start", F.element_at("walk", F.col("i")).alias("src_id"), F.element_at("walk", F.col("i") + 1).alias("dst_id"))
    off = steps.join(pairs, ["src_id", "dst_id"], "left").groupBy("start").agg(F.count_if(F.col("edge").isNull()).alias("off"))
    leaving = g.edges.filter("weight > 0").select(F.col("src_id").alias("tail")).distinct().withColumn("leaves", F.lit(True))
    whole = walks.select("start", F.size("walk").alias("n"), F.element_at("walk", -1).alias("tail")).join(leaving, "tail", "left")
    return whole.join(off, "start", "left").select("start", F.coalesce("off", F.lit(0)).alias("off_graph"), ((F.col("n") == 6) | F.col("leaves").isNull()).alias("as_long_as_it_can"))
