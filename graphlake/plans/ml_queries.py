"""Learning queries over the test tables; most results depend on training, and only what must hold of them has SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.ml import embed, gnn
from graphlake.ml.registry import ModelRegistry
from graphlake.ml.tabular import Tables
from graphlake.operators.graph import PropertyGraph
from graphlake.plans.graph_queries import _TRADE, bazaar, trade
from graphlake.storage import Rounds, read_table

QUERIES: dict = {}
ORACLES = {
    "deepwalk_embeddings": f"WITH {_TRADE} SELECT CAST(count(*) AS BIGINT) AS n_vertices, CAST(16 AS INTEGER) AS dim, true AS linked_nearer FROM (SELECT src_id FROM trade UNION SELECT dst_id FROM trade)",
    "graph_models_learn_from_neighbours": "SELECT * FROM (VALUES ('full_gcn', true), ('sampled_gcn', true), ('supervised_sage', true)) t(model, learned)",
}


def _register(f):
    QUERIES[f.__name__] = f
    return f


def _models(spark) -> Tables:
    return Tables(ModelRegistry(spark, Rounds(spark, "models").base))


def _vectors(spark, d) -> tuple[DataFrame, list[str]]:
    """The embeddings with each element as a column, and the names of these."""
    e = read_table(spark, d, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"x{i}" for i in range(n)]
    wide = e.select("vec_id", "label", (F.col("label") % 2).alias("odd"), *(F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(names)))
    # written, because a filter over many named expressions makes the optimizer double its constraints for each of them
    return Rounds(spark, "vectors").write(wide)[0], names


def _lines(spark, d) -> DataFrame:
    x = read_table(spark, d, "lineitem")
    return x.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@_register
def linreg_predict(spark, d):
    t, x = _models(spark), _lines(spark, d)
    return t.predict(t.train_linear_regression(x, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), x, "line")


@_register
def logreg_predict(spark, d):
    t, (x, features) = _models(spark), _vectors(spark, d)
    return t.predict(t.train_logistic_regression(x, features, "odd"), x, "vec_id", "probability")


@_register
def rf_predict(spark, d):
    t, (x, features) = _models(spark), _vectors(spark, d)
    return t.predict(t.train_random_forest_classifier(x, features, "label"), x, "vec_id")


@_register
def gbt_predict(spark, d):
    t, x = _models(spark), _lines(spark, d)
    return t.predict(t.train_boosting_tree_regressor(x, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 5), x, "line")


@_register
def mlp_predict(spark, d):
    t, (x, features) = _models(spark), _vectors(spark, d)
    return t.predict(t.train_neural_network_classifier(x, features, "label", epochs=3, batch_size=64, rate=0.01), x, "vec_id")


@_register
def mlp_evaluate(spark, d):
    """Loss and accuracy of a network, and of the same network trained on."""
    t, (x, features) = _models(spark), _vectors(spark, d)
    first = t.train_neural_network_classifier(x, features, "label", epochs=2, batch_size=64, rate=0.01)
    again = t.train_from(first, x)
    rows = [(i, *t.evaluate(m, x, metrics=["loss", "accuracy"])) for i, m in enumerate((first, again))]
    return spark.createDataFrame(rows, "run int, loss double, accuracy double")


def _linked_nearer(g: PropertyGraph, vectors: DataFrame) -> DataFrame:
    """(n_vertices, dim, linked_nearer): whether the ends of edges are alike, on average, more than those of strangers."""
    v, _ = Rounds(vectors.sparkSession, "vectors").write(vectors.select("id", "embedding"))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = v.select("id", F.transform("embedding", lambda x: x.cast("double") / F.greatest(size, F.lit(1e-12))).alias("e"))
    links = g.links().select(F.col("src_id").cast("string").alias("a"), F.col("dst_id").cast("string").alias("b")).filter("a <> b")
    # a stranger is the other end of the link that comes next in an order by hash
    order = Window.partitionBy(F.pmod(F.xxhash64("a"), F.lit(64))).orderBy(F.xxhash64("a", "b"), "a", "b")
    strangers = links.select("a", F.lead("b").over(order).alias("b")).filter("a <> b")
    pairs = links.withColumn("linked", F.lit(1)).unionAll(strangers.withColumn("linked", F.lit(0)))
    met = pairs.join(unit.select(F.col("id").alias("a"), F.col("e").alias("x")), "a").join(unit.select(F.col("id").alias("b"), F.col("e").alias("y")), "b")
    dim = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    # written out, because lambdas are not compiled
    dot = sum((F.get("x", F.lit(i)) * F.get("y", F.lit(i)) for i in range(dim)), F.lit(0.0))
    near = met.agg(F.avg(F.when(F.col("linked") == 1, dot)).alias("l"), F.avg(F.when(F.col("linked") == 0, dot)).alias("s"))
    return v.agg(F.count(F.lit(1)).alias("n_vertices"), F.max(F.size("embedding")).alias("dim")).crossJoin(near).select("n_vertices", "dim", (F.col("l") > F.col("s")).alias("linked_nearer"))


@_register
def deepwalk_embeddings(spark, d):
    g = trade(spark, d)
    return _linked_nearer(g, embed.deepwalk(g, walk_len=6, walks_per_vertex=4, dim=16, weight="weight"))


@_register
def line_embeddings(spark, d):
    g = trade(spark, d)
    return _linked_nearer(g, embed.line(g, proximity=2, dim=16, samples=2))


def _shop(spark, d) -> PropertyGraph:
    g = bazaar(spark, d)
    v = g.vertices.withColumn("vt", F.when(F.col("vtype") == "customer", 1).when(F.col("vtype") == "order", 2).otherwise(3)).withColumn("size", F.length("label").cast("double")).withColumn("code", F.pmod(F.xxhash64("label"), F.lit(7)).cast("double"))
    return PropertyGraph(g.edges.withColumn("et", F.when(F.col("etype") == "placed", 1).otherwise(2)), v)


_TYPES = {"vertex_type": "vt", "edge_type": "et"}


def _busy(spark, d) -> tuple[PropertyGraph, DataFrame]:
    """The shop with 1 as label of the customers whose orders are worth more than half of all customers' orders are: nothing of it stands at the customer."""
    g = _shop(spark, d)
    o = read_table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_totalprice").alias("worth"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"))
    vertices = g.vertices.join(o.select("id", "worth"), "id", "left")
    spent = o.groupBy(F.col("customer").alias("id")).agg(F.avg("worth").alias("spent"))
    half = spent.agg(F.percentile_approx("spent", 0.5, 10_000)).first()[0] or 0.0
    return PropertyGraph(g.edges, vertices), spent.select("id", (F.col("spent") > half).cast("int").alias("label"))


def _graph_model(spark, d, kind: str, **how):
    g, labels = _busy(spark, d)
    models = gnn.GraphModels(_models(spark))
    train = getattr(models, f"train_{kind}")
    return g, labels, models, train(g, labels, ["worth", "size"], ["(1)-[1]->(2)"], **_TYPES, **how)


@_register
def sage_predict(spark, d):
    """Whether customers spend much, from what their orders are worth."""
    g, _, models, m = _graph_model(spark, d, "supervised_sage", k=16, epochs=6, batch_size=32, rate=0.02)
    return models.predict(m, g)


@_register
def graph_models_learn_from_neighbours(spark, d):
    """Whether each graph network tells spenders better than chance, which nothing at the customer itself does."""
    rows = []
    for kind, how in (("full_gcn", {}), ("sampled_gcn", {"k": 16}), ("supervised_sage", {"k": 16})):
        g, labels, models, m = _graph_model(spark, d, kind, epochs=8, batch_size=32, rate=0.02, **how)
        info = models.tables.registry.info(m)
        rows.append((info.category, models.evaluate(m, g, labels, metrics=["accuracy"])[0] > 0.8))
    return spark.createDataFrame(rows, "model string, learned boolean")


@_register
def unsupervised_sage_embeddings(spark, d):
    g = _shop(spark, d)
    return gnn.unsupervised_sage(g, ["size", "code"], ["(1)-[1]->(2)-[2]->(3)"], "(1)-[1]->(2)-[2]->(3)<-[2]-(2)<-[1]-(1)", k=5, weight="quantity", **_TYPES).select("id", F.size("embedding").alias("dim"))
