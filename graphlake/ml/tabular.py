"""Training, prediction and evaluation on tables, with a registry of models.

Linear models, forests and boosted trees are MLlib's; dense networks are those
of ``mlp``. A row belongs to the validation part by a hash of its features, so
the split is the same wherever a row is read.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.ml.mlp import Network, doubles, evaluate_network, predict_network, train_network
from graphlake.ml.registry import NETWORKS, REGRESSORS, ModelInfo, ModelRegistry

#: Layers of a network when none are given.
DEFAULT_LAYERS = [("dense", "units=32,activation=tanh"), ("dense", "units=64,activation=tanh"), ("dense", "units=64,activation=tanh"), ("dense", "units=1")]
VALID_SHARE = 0.25


def split(df: DataFrame, columns: Sequence[str], share: float = VALID_SHARE) -> tuple[DataFrame, DataFrame]:
    """(training, validation) rows by a hash of some columns."""
    u = F.pmod(F.xxhash64(*columns), F.lit(10_000))
    return df.filter(u >= share * 10_000), df.filter(u < share * 10_000)


def _clean(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    return df.select(*doubles(df, x), F.col(y).cast("double").alias("label")).na.drop()


def _weight(weights: dict[float, float] | None) -> Column:
    w = F.lit(1.0)
    for k, v in (weights or {}).items():
        w = F.when(F.col("label") == k, F.lit(v)).otherwise(w)
    return w


class Tables:
    """Models of tables in one registry."""

    def __init__(self, registry: ModelRegistry):
        self.registry = registry

    # dense networks

    def train(self, table: DataFrame, x: Sequence[str], y: str, layers: Sequence = (), loss: str = "mse", optimizer: str = "adam", rate: float = 0.001, epochs: int = 10, batch_size: int = 1024, class_weight: dict | None = None, valid_share: float = VALID_SHARE, category: str = "sequential", parent: str | None = None, passes: int = 1) -> str:
        """Train a network of named layers; the id of the model."""
        net = Network.build(len(x), list(layers) or DEFAULT_LAYERS, loss)
        return self._fit(net, table, x, y, list(layers) or DEFAULT_LAYERS, optimizer, rate, epochs, batch_size, class_weight, valid_share, category, parent, passes)

    def train_from(self, model_id: str, table: DataFrame, x: Sequence[str] | None = None, y: str | None = None, **changed) -> str:
        """Go on training a stored network; what is not given is taken from its entry. The id of the new model."""
        info = self.registry.info(model_id)
        net = self._network(model_id)
        p = {**info.params, **changed}
        return self._fit(net, table, x or info.x_columns, y or info.y_column, info.definition, p["optimizer"], p["rate"], p["epochs"], p["batch_size"], {float(k): v for k, v in (p["class_weight"] or {}).items()} or None, p["valid_share"], info.category, model_id, p["passes"])

    def _fit(self, net, table, x, y, definition, optimizer, rate, epochs, batch_size, class_weight, valid_share, category, parent, passes, extra: dict | None = None) -> str:
        train, valid = split(_clean(table, x, y), [*x, "label"], valid_share)
        history = train_network(net, train, x, "label", epochs, batch_size, optimizer, rate, class_weight, valid if valid_share else None, passes)
        params = {"optimizer": optimizer, "rate": rate, "epochs": epochs, "batch_size": batch_size, "class_weight": class_weight, "valid_share": valid_share, "passes": passes, **(extra or {})}
        info = ModelInfo(category, list(x), y, [list(d) for d in definition], params, history[-1] if history else {}, parent_id=parent)
        self.registry.write(info, history)
        self.registry.spark.createDataFrame([(bytearray(pickle.dumps(net)),)], "network binary").write.mode("overwrite").parquet(info.save_path)
        return info.model_id

    def _network(self, model_id: str) -> Network:
        return pickle.loads(bytes(self.registry.spark.read.parquet(self.registry.save_path(model_id)).first()["network"]))

    def train_neural_network_classifier(self, table: DataFrame, x: Sequence[str], y: str, hidden: Sequence[int] = (32, 32), **kw) -> str:
        """A relu network with an output for each different label; labels are 0, 1, 2, ..."""
        n = table.agg(F.max(F.col(y).cast("int"))).first()[0] + 1
        layers = [*(("dense", {"units": h, "activation": "relu"}) for h in hidden), ("dense", {"units": n})]
        return self.train(table, x, y, layers, "sparse_categorical_crossentropy", category="neural_network_classifier", **kw)

    def train_neural_network_regressor(self, table: DataFrame, x: Sequence[str], y: str, hidden: Sequence[int] = (32, 32), **kw) -> str:
        """A tanh network with one output."""
        layers = [*(("dense", {"units": h, "activation": "tanh"}) for h in hidden), ("dense", {"units": 1})]
        return self.train(table, x, y, layers, "mse", category="neural_network_regressor", **kw)

    # MLlib

    def _estimate(self, table: DataFrame, x: Sequence[str], y: str, estimator, category: str, weights: dict | None = None, valid: bool = False) -> str:
        data = _clean(table, x, y).withColumn("_w", _weight(weights))
        if valid:
            data = data.withColumn("_valid", F.pmod(F.xxhash64(*x, "label"), F.lit(10_000)) < VALID_SHARE * 10_000)
        model = Pipeline(stages=[VectorAssembler(inputCols=list(x), outputCol="features"), estimator]).fit(data)
        last = model.stages[-1]
        history = [{"loss": float(v)} for v in last.summary.objectiveHistory] if getattr(last, "hasSummary", False) and last.summary.objectiveHistory else []
        info = ModelInfo(category, list(x), y, None, {"class_weight": weights}, history[-1] if history else {})
        self.registry.write(info, history)
        model.write().overwrite().save(info.save_path)
        return info.model_id

    def train_linear_regression(self, table: DataFrame, x: Sequence[str], y: str) -> str:
        return self._estimate(table, x, y, LinearRegression(), "linear_regression")

    def train_logistic_regression(self, table: DataFrame, x: Sequence[str], y: str, class_weight: dict | None = None) -> str:
        """Two classes, 0 and 1."""
        return self._estimate(table, x, y, LogisticRegression(weightCol="_w", family="binomial"), "logistic_regression", class_weight)

    @staticmethod
    def forest_size(n: int) -> int:
        """Trees of a forest: one for each 1,024 rows, from 10 to 100."""
        return max(10, min(100, n // 1024))

    def train_random_forest_classifier(self, table: DataFrame, x: Sequence[str], y: str, positive_class_weight: float = 1.0) -> str:
        n, labels = table.agg(F.count(F.lit(1)), F.countDistinct(y)).first()
        if labels < 2:
            raise ValueError("a classifier needs two classes")
        return self._estimate(table, x, y, RandomForestClassifier(numTrees=self.forest_size(n), maxDepth=5, weightCol="_w", seed=1), "random_forest_classifier", {1.0: positive_class_weight})

    def train_random_forest_regressor(self, table: DataFrame, x: Sequence[str], y: str) -> str:
        return self._estimate(table, x, y, RandomForestRegressor(numTrees=self.forest_size(table.count()), maxDepth=5, seed=1), "random_forest_regressor")

    def train_boosting_tree_classifier(self, table: DataFrame, x: Sequence[str], y: str, epochs: int = 20, positive_class_weight: float = 1.0) -> str:
        """Boosted trees; more than two classes one against the rest. Stops early on the validation part."""
        labels = table.agg(F.countDistinct(y)).first()[0]
        if labels < 2:
            raise ValueError("a classifier needs two classes")
        gbt = GBTClassifier(maxIter=epochs, maxDepth=5, stepSize=0.2, featureSubsetStrategy="0.75", weightCol="_w", seed=1)
        if labels > 2:
            return self._estimate(table, x, y, OneVsRest(classifier=gbt, weightCol="_w"), "boosting_tree_classifier")
        return self._estimate(table, x, y, gbt.setValidationIndicatorCol("_valid"), "boosting_tree_classifier", {1.0: positive_class_weight}, valid=True)

    def train_boosting_tree_regressor(self, table: DataFrame, x: Sequence[str], y: str, epochs: int = 20) -> str:
        gbt = GBTRegressor(maxIter=epochs, maxDepth=5, stepSize=0.2, featureSubsetStrategy="0.75", validationIndicatorCol="_valid", seed=1)
        return self._estimate(table, x, y, gbt, "boosting_tree_regressor", valid=True)

    # prediction and evaluation

    def predict(self, model_id: str, table: DataFrame, id_column: str, result_type: str = "class") -> DataFrame:
        """(id, predict): id as text; a class, a number, or with result_type 'probability' an array of scores; null where an input is null."""
        info = self.registry.info(model_id)
        key = F.col(id_column).cast("string").alias("id")
        regression = info.category in REGRESSORS
        if info.category in NETWORKS:
            out = predict_network(self._network(model_id), table.select(key, *info.x_columns), info.x_columns, ["id"])
            if result_type == "probability":
                return out.select("id", F.col("scores").alias("predict"))
            best = F.array_position("scores", F.array_max("scores")) - 1
            return out.select("id", F.when(F.size("scores") == 1, F.col("scores")[0]).otherwise(best.cast("double")).alias("predict")) if regression or info.category == "sequential" else out.select("id", best.cast("int").alias("predict"))
        # a row with a null has no prediction, whatever the kind of model
        values = doubles(table, info.x_columns)
        rows = table.select(key, *values).withColumn("_whole", ~F.greatest(*(F.col(c).isNull() for c in info.x_columns), F.lit(False))).na.fill(0.0, list(info.x_columns))
        out = PipelineModel.load(self.registry.save_path(model_id)).transform(rows)
        if result_type == "probability" and "probability" in out.columns:
            return out.select("id", F.when(F.col("_whole"), vector_to_array("probability")).alias("predict"))
        return out.select("id", F.when(F.col("_whole"), F.col("prediction").cast("double" if regression else "int")).alias("predict"))

    def evaluate(self, model_id: str, table: DataFrame, y: str | None = None, metrics: Sequence[str] = ()) -> list[float]:
        """Values of the metrics over all rows; by default accuracy of classifiers and the root of the mean square of regressors."""
        info = self.registry.info(model_id)
        y = y or info.y_column
        if info.category in NETWORKS:
            return evaluate_network(self._network(model_id), table, info.x_columns, y, list(metrics) or ["loss"])
        rows = _clean(table, info.x_columns, y)
        out = PipelineModel.load(self.registry.save_path(model_id)).transform(rows)
        d = F.col("prediction") - F.col("label")
        known = {"accuracy": F.avg((d == 0).cast("double")), "error": F.avg((d != 0).cast("double")), "mse": F.avg(d * d), "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d))}
        regression = info.category in REGRESSORS
        names = list(metrics) or ["rmse" if regression else "accuracy"]
        row = out.agg(*(known[m].alias(m) for m in names)).first()
        return [float(row[m]) for m in names]
