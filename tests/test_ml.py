import numpy as np
import pytest

from graphlake.ml.mlp import LOSSES, METRICS, OPTIMIZERS, Network, UnsupportedLayer, _flat, _optimize, _unflat, evaluate_network
from graphlake.ml.registry import ModelRegistry, class_weights, parse_pairs
from graphlake.ml.tabular import Tables
from graphlake.plans.ml_queries import QUERIES


@pytest.mark.parametrize("loss", LOSSES)
def test_gradients_match_differences(loss):
    out = {"sparse_categorical_crossentropy": ("dense", "units=3"), "categorical_crossentropy": ("dense", "units=1,activation=sigmoid"), "binary_crossentropy": ("dense", "units=1,activation=sigmoid")}.get(loss, ("dense", "units=1"))
    net = Network.build(4, [("dense", "units=5,activation=tanh"), ("elu", ""), out], loss)
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(6, 4)), rng.integers(0, 2, 6).astype(float), np.ones(6)
    grads, _ = net.gradients(x, y, w, rng)
    for i in range(len(net.params)):
        for j in list(np.ndindex(net.params[i].shape))[:4]:
            keep, h = net.params[i][j], 1e-6
            net.params[i][j] = keep + h
            up = net.loss_of(net.forward(x)[0], y, w)[0]
            net.params[i][j] = keep - h
            down = net.loss_of(net.forward(x)[0], y, w)[0]
            net.params[i][j] = keep
            assert grads[i][j] == pytest.approx((up - down) / (2 * h), abs=1e-4)


def test_unknown_parts_are_refused():
    for layers, loss in (([("conv2d", "filters=3")], "mse"), ([("dense", "units=1,activation=swoosh")], "mse"), ([("dense", "units=1")], "ctc")):
        with pytest.raises(UnsupportedLayer):
            Network.build(2, layers, loss)


def test_pairs():
    assert parse_pairs("a=1, b=0.5,c=x") == {"a": 1, "b": 0.5, "c": "x"}
    assert class_weights("0=1.0,1=2") == {0.0: 1.0, 1.0: 2.0} and parse_pairs(None) == {}


def test_models_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    rows = [(i, float(a), float(b), float(3 * a - b + 1), int(a + b > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double, c int")
    t = Tables(ModelRegistry(spark, str(tmp_path / "r")))
    lin = t.train_linear_regression(df, ["a", "b"], "y")
    assert t.evaluate(lin, df) == pytest.approx([0], abs=1e-3)
    net = t.train_neural_network_classifier(df, ["a", "b"], "c", hidden=(8,), epochs=4, batch_size=32, rate=0.02, passes=4)
    assert t.evaluate(net, df, metrics=["accuracy"])[0] > 0.9
    more = t.train_from(net, df, epochs=1)
    info = t.registry.info(more)
    assert info.parent_id == net and t.registry.log(more).count() == 1
    assert {r["predict"] for r in t.predict(net, df, "id").collect()} == {0, 1}
    assert len(t.predict(net, df, "id", "probability").first()["predict"]) == 2
    gbt = t.train_boosting_tree_classifier(df, ["a", "b"], "c", epochs=3)
    assert t.evaluate(gbt, df)[0] > 0.85
    with pytest.raises(ValueError):
        t.train_random_forest_classifier(df.filter("c = 1"), ["a", "b"], "c")
    with pytest.raises(KeyError):
        t.registry.info("nobody")


def test_table_models_use_every_element_of_an_embedding(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 10))
    data = [(i, int(v[9] > 0), [float(x) for x in v]) for i, v in enumerate(vectors)]
    spark.createDataFrame(data, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    scores = {int(r["id"]): r["predict"][1] for r in QUERIES["logreg_predict"](spark, str(tmp_path)).collect()}
    assert sum((scores[i] > 0.5) == bool(label) for i, label, _ in data) / len(data) > 0.95


def test_batch_normalisation_predicts_as_it_was_trained(spark):
    rng = np.random.default_rng(2)
    net = Network.build(3, [("batchnormalization", ""), ("dense", "units=1")], "mse")
    x = rng.normal(50, 20, size=(200, 3))
    for _ in range(60):
        net.forward(x, rng)
    assert net.forward(x)[0] == pytest.approx(net.forward(x, rng)[0], rel=0.02, abs=0.05)


def test_batch_normalisation_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network.build(3, [("dense", "units=4,activation=tanh"), ("batchnormalization", "momentum=1"), ("dense", "units=1")], "mse")
    x, y, w = rng.normal(size=(7, 3)), rng.normal(size=7), np.ones(7)
    grads, _ = net.gradients(x, y, w, rng)
    for i in (0, 1, 2, 3, 6, 7):
        for j in list(np.ndindex(net.params[i].shape))[:4]:
            keep, h = net.params[i][j], 1e-6
            net.params[i][j] = keep + h
            up = net.loss_of(net.forward(x, rng)[0], y, w)[0]
            net.params[i][j] = keep - h
            down = net.loss_of(net.forward(x, rng)[0], y, w)[0]
            net.params[i][j] = keep
            assert grads[i][j] == pytest.approx((up - down) / (2 * h), abs=1e-5)


@pytest.mark.parametrize("kind", OPTIMIZERS)
def test_optimizers_go_downhill(kind):
    rng = np.random.default_rng(1)
    net = Network.build(2, [("dense", "units=1")], "mse")
    x = rng.normal(size=(64, 2))
    y, state = x @ np.array([1.0, -2.0]), {}
    first = net.loss_of(net.forward(x)[0], y, np.ones(64))[0]
    for _ in range(300):
        grads, _ = net.gradients(x, y, np.ones(64), rng)
        _optimize(net, grads, state, kind, {"adadelta": 20.0, "ftrl": 0.5}.get(kind, 0.05))
        state = _unflat(net, _flat(net, state))
    assert net.loss_of(net.forward(x)[0], y, np.ones(64))[0] < first / 4


def test_metrics_of_a_network(spark):
    net = Network.build(1, [("dense", "units=1")], "mse")
    net.params = [np.array([[1.0]]), np.array([0.0])]
    df = spark.createDataFrame([(0.9, 1.0), (0.2, 0.0), (0.8, 0.0), (0.1, 1.0), (None, 1.0)], "x double, y double")
    got = dict(zip(METRICS, evaluate_network(net, df, ["x"], "y", METRICS), strict=True))
    assert (got["true_positives"], got["false_positives"], got["true_negatives"], got["false_negatives"]) == (1, 1, 1, 1)
    assert got["accuracy"] == got["precision"] == got["recall"] == got["f1"] == 0.5
    assert got["mae"] == pytest.approx((0.1 + 0.2 + 0.8 + 0.9) / 4) and got["hinge"] == pytest.approx((0.1 + 1.2 + 1.8 + 0.9) / 4)


def test_a_row_with_a_null_has_no_prediction(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(40)], "id int, x double, y double")
    t = Tables(ModelRegistry(spark, str(tmp_path / "r")))
    models = [t.train_linear_regression(df, ["x"], "y"), t.train_neural_network_regressor(df, ["x"], "y", epochs=1)]
    more = spark.createDataFrame([(1, 3.0), (2, None)], "id int, x double")
    for m in models:
        assert {r["id"]: r["predict"] is None for r in t.predict(m, more, "id").collect()} == {"1": False, "2": True}
    assert [t.registry.info(m).category for m in models] == ["linear_regression", "neural_network_regressor"]
