import numpy as np
import pytest
from conftest import rows

from graphlake.ml import fields as X
from graphlake.ml.gnn import GraphModels
from graphlake.ml.mlp import UnsupportedLayer
from graphlake.ml.registry import ModelRegistry
from graphlake.ml.tabular import Tables
from graphlake.operators.graph import PropertyGraph

SPEC = X.FieldSpec(("a", "b"), ("(1)-[1]->(1)-[1]->(1)",), 2, lookups=("c",), buckets=5, mean=(0.0, 0.0), sd=(1.0, 1.0))


def batch(rng, n=6):
    """Fields with missing neighbours, whose fields are missing too."""
    out = []
    for _ in range(n):
        def one(hops, there):
            row = [*rng.normal(size=2), float(rng.integers(5)), 1.0] if there else [0.0] * 4
            if hops:
                count = rng.integers(0, 3) if there else 0
                for k in range(2):
                    row += one(hops - 1, k < count)
            return row
        out.append(one(2, True))
    return np.array(out)


@pytest.mark.parametrize("how", [{}, {"agg": "sum"}, {"agg": "max"}, {"tied": True}, {"wide": True}])
def test_gradients_match_differences(how):
    rng = np.random.default_rng(0)
    net = X.FieldNetwork.make(SPEC, [4, 3], 2, activation="tanh", dim=2, **how)
    x, y, w = batch(rng), rng.integers(0, 2, 6).astype(float), np.ones(6)
    assert x.shape[1] == net.inputs
    grads, _ = net.gradients(x, y, w, rng)
    for i in range(len(net.params)):
        for j in list(np.ndindex(net.params[i].shape))[:6]:
            keep, h = net.params[i][j], 1e-6
            net.params[i][j] = keep + h
            up = net.loss_of(net.forward(x)[0], y, w)[0]
            net.params[i][j] = keep - h
            down = net.loss_of(net.forward(x)[0], y, w)[0]
            net.params[i][j] = keep
            assert grads[i][j] == pytest.approx((up - down) / (2 * h), abs=1e-5), (i, j)


def two_groups(spark, n=120):
    """Vertices of type 1 whose label is that of most of their neighbours of type 2; they have no sign of it themselves."""
    rng = np.random.default_rng(4)
    v = [(i, 1, float(rng.normal()), "x") for i in range(n)] + [(1000 + i, 2, float(i % 2) * 2 - 1 + 0.1 * float(rng.normal()), "odd" if i % 2 else "even") for i in range(40)]
    e = [(i, 1000 + 2 * int(rng.integers(20)) + i % 2, 7, 1.0) for i in range(n) for _ in range(5)] + [(0, 5000, 7, 1.0)]
    g = PropertyGraph.from_edges(spark.createDataFrame(e, "src_id bigint, dst_id bigint, etype int, weight double"), vertices=spark.createDataFrame([*v, (5001, 1, None, None)], "id bigint, vtype int, a double, kind string"))
    return g, spark.createDataFrame([(i, i % 2) for i in range(n)] + [(3, None)], "id bigint, label int")


def test_graph_networks_learn_what_only_neighbours_know(spark, tmp_path):
    g, labels = two_groups(spark)
    models = GraphModels(Tables(ModelRegistry(spark, str(tmp_path / "r"))))
    paths, head = ["(1)-[7]->(2)"], {"epochs": 12, "batch_size": 16, "rate": 0.03}
    sage = models.train_supervised_sage(g, labels, ["a"], paths, 4, hidden=[6], **head)
    for m, kind in ((sage, "supervised_sage"), (models.train_sampled_gcn(g, labels, ["a"], paths, 4, hidden=[6], **head), "sampled_gcn"), (models.train_full_gcn(g, labels, ["a"], paths, **head), "full_gcn")):
        assert models.tables.registry.info(m).category == kind
        # all neighbours are added to the noise of the vertex itself
        assert models.evaluate(m, g, labels, metrics=["accuracy"])[0] > (0.75 if kind == "full_gcn" else 0.9), kind
    by_name = models.train_supervised_sage(g, labels, [], paths, 4, hidden=[6], lookups=["kind"], **head)
    assert models.evaluate(by_name, g, labels, metrics=["accuracy"])[0] > 0.9
    own = models.tables.train_neural_network_classifier(g.vertices.join(labels, "id"), ["a"], "label", epochs=3, batch_size=16)
    assert models.tables.evaluate(own, g.vertices.join(labels, "id"), metrics=["accuracy"])[0] < 0.75
    p = {r["id"]: r["predict"] for r in models.predict(sage, g).collect()}
    assert len(p) == 121 and sum(p[i] == i % 2 for i in range(120)) > 105
    for kind, size in (("logit", 2), ("probability", 2), ("embedding", 6)):
        got = models.predict(sage, g, kind).first()["predict"]
        assert len(got) == size and (kind != "probability" or sum(got) == pytest.approx(1))
    with pytest.raises(ValueError):
        models.predict(own, g)
    with pytest.raises(ValueError):
        models.predict(sage, g, "colour")


def test_fields_are_laid_out_by_weight(spark):
    v = [(1, 1, 10.0), (2, 2, 20.0), (3, 2, 30.0), (4, 2, 40.0), (9, 1, None)]
    e = [(1, 2, 7, 1.0), (1, 3, 7, 3.0), (1, 4, 7, 2.0), (1, 9, 7, 99.0)]
    g = PropertyGraph.from_edges(spark.createDataFrame(e, "src_id bigint, dst_id bigint, etype int, weight double"), vertices=spark.createDataFrame(v, "id bigint, vtype int, a double"))
    spec = X.FieldSpec(("a",), ("(1)-[7]->(2)",), 2, "weight", mean=(0.0,), sd=(1.0,))
    df, names = X.sampled_fields(g, spec)
    assert rows(df.select("id", *names)) == [(1, 10.0, 1.0, 30.0, 1.0, 40.0, 1.0), (9, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)]


def test_unknown_aggregators_are_refused():
    with pytest.raises(UnsupportedLayer):
        X.FieldNetwork.make(SPEC, [3, 3], 2, agg="median")
    with pytest.raises(ValueError):
        X.FieldNetwork.make(SPEC, [3], 2)
