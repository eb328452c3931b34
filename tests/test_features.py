import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphlake.functions import features as P
from graphlake.ml import sampling
from graphlake.sources import readers


@pytest.fixture
def freq(spark):
    return spark.createDataFrame([(v,) for v in ["a"] * 5 + ["b"] * 3 + ["c"] * 2 + [None]], "v string")


def test_frequent_values(freq):
    assert rows(P.most_common(freq, "v")) == [("a",)]
    assert [r["value"] for r in P.top_n(freq, "v", 2).orderBy("rank").collect()] == ["a", "b"]
    assert P.top_n(freq, "v", 99).count() == 4
    assert rows(P.top_percent(freq, "v", 0.7)) == [(1, "a", 5), (2, "b", 3)]
    assert P.top_percent(freq, "v", 1.0).count() == 4


def test_binarize_and_onehot(spark):
    df = spark.createDataFrame([(1,), (13,), (None,)], "x int")
    got = df.select(P.binarize(F.col("x"), 5).alias("b"), P.onehot_encode(F.col("x"), [0, 3, 1], True).alias("o"), P.onehot_encode(F.col("x"), [0, 3, 1]).alias("p"), P.onehot_ids(F.col("x"), 2).alias("i")).collect()
    assert tuple(got[0]) == (0, [0, 0, 1, 0], [0, 0, 1], [1, 0])
    assert tuple(got[1]) == (1, [0, 0, 0, 1], [0, 0, 0], [0, 0])
    assert tuple(got[2]) == (None, None, None, None)


def test_impute(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,)], "x double")
    want = {"constant": 9.0, "mode": 1.0, "max": 4.0, "min": 1.0, "avg": 2.0, "median": 1.0}
    for how, fill in want.items():
        assert sorted(r["x"] for r in P.impute(df, "x", how, 9.0).collect()) == sorted([1.0, 1.0, 4.0, fill])
    assert P.impute(df, "x", "drop").count() == 3


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert [r["x"] for r in P.standardize(df, "x").collect()] == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2)])
    assert [r["x"] for r in P.l1_normalize(df, "x").collect()] == [0.25, 0.75]
    got = P.minmax(df, "x", "y").collect()
    assert [(r["x"], r["y"]) for r in got] == [(0.0, 0.0), (1.0, 0.0)]
    assert [r["y"] for r in P.standardize(df, "y").collect()] == [None, None]


def test_sources(spark, graph, tmp_path):
    g = graph([(1, 2), (2, 3)])
    readers.write_edges(g, str(tmp_path / "e"))
    assert rows(readers.load_edges(spark, str(tmp_path / "e")).links()) == [(1, 2), (2, 3)]
    readers.write_by_type(g, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("etype = 'x'").count() == 2
    assert [len(b) for b in readers.batches(spark.range(5), ["id"], 2, ["id"])] == [2, 2, 1]
    t = spark.createDataFrame([("1", "2", '{"weight": 2.5}', "a"), ("1", "3", "{broken", "a"), (None, "3", None, "a")], "owner_vertex string, other_vertex string, properties string, etype string")
    assert sorted((r["dst_id"], r["weight"]) for r in readers.graph_from_json_tables(t, weight_key="weight").edges.collect()) == [("2", 2.5), ("3", None)]


def test_sampling(spark, graph):
    g = graph([(1, i, "x", i) for i in range(2, 10)] + [(2, 1)])
    assert [r["dst_id"] for r in sampling.top_neighbours(g, 2, "weight").filter("src_id = 1").orderBy("rank").collect()] == [9, 8]
    a, b = (rows(sampling.random_neighbours(g, 3, seed=s).select("src_id", "dst_id")) for s in (1, 1))
    assert a == b and len(a) == 4 and len(set(a)) == 4
    neg = sampling.negative_samples(g, 5, seed=3).collect()
    assert all((r["src_id"], r["neg_id"]) not in {(1, i) for i in range(2, 10)} | {(2, 1)} and r["src_id"] != r["neg_id"] for r in neg)
    edges = {(1, i) for i in range(2, 10)} | {(2, 1)}
    for r in sampling.random_walks(g, 4, seed=2).collect():
        assert all(e in edges for e in zip(r["walk"], r["walk"][1:], strict=False))
    w = spark.createDataFrame([([1, 2, 3, 4],)], "w array<int>")
    assert rows(sampling.skipgram_pairs(w, "w", 1)) == [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)]
    brute = sorted((x, y) for i, x in enumerate([1, 2, 3, 4]) for j, y in enumerate([1, 2, 3, 4]) if i != j and abs(i - j) <= 2)
    assert rows(sampling.skipgram_pairs(w, "w", 2)) == brute


def test_receptive_field(graph):
    from graphlake.operators.graph import PropertyGraph

    g = graph([(1, 2, "1", 1), (1, 3, "1", 2), (2, 4, "2", 1)], vertices=[(1, 1), (2, 2), (3, 2), (4, 1)])
    g = PropertyGraph(g.edges.withColumn("etype", F.col("etype").cast("int")), g.vertices)
    assert rows(sampling.receptive_field(g, "(1)-[1]->(2)-[2]->(1)", vertex_type="kind")) == [(1, 2, 4)]
    assert rows(sampling.receptive_field(g, "(1)-[1]->(2)", vertex_type="kind", k=1, weight="weight")) == [(1, 3)]


def test_top_percent_over_many_cuts(spark, monkeypatch):
    from graphlake.operators import skew

    data = [(f"v{i:03d}",) for i in range(90)] + [("v005",)] * 3 + [("v007",)] * 3 + [(None,)]
    df = spark.createDataFrame(data, "v string")
    want = rows(P.top_percent(df, "v", 0.8))
    monkeypatch.setattr(skew, "ROWS_PER_CUT", 7)
    assert rows(P.top_percent(df, "v", 0.8)) == want and want[:3] == [(1, "v005", 4), (2, "v007", 4), (3, "v000", 1)]
    assert [r[0] for r in want] == list(range(1, len(want) + 1))


def test_walks_follow_weights_through_hubs(spark, graph, monkeypatch):
    from graphlake.operators import skew

    monkeypatch.setattr(skew, "ROWS_PER_CUT", 9)
    g = graph([(0, k, "x", 30.0 if k == 5 else 1.0) for k in range(1, 31)] + [(k, 0) for k in range(1, 31)])
    starts = spark.createDataFrame([(k,) for k in range(1, 31)], "id bigint")
    walks = [r["walk"] for s in range(6) for r in sampling.random_walks(g, 2, seed=s, weight="weight", starts=starts).collect()]
    assert all(len(w) == 3 and w[1] == 0 for w in walks)
    assert 0.35 < sum(w[2] == 5 for w in walks) / len(walks) < 0.67
