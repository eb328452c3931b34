"""Model registry, training logs and artefact folders as Parquet under one root."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of models by family.
NETWORKS = ("sequential", "neural_network_classifier", "neural_network_regressor")
TREES = ("random_forest_classifier", "random_forest_regressor", "boosting_tree_classifier", "boosting_tree_regressor")
LINEAR = ("linear_regression", "logistic_regression")
GRAPHS = ("full_gcn", "sampled_gcn", "supervised_sage", "unsupervised_sage", "deepwalk", "line")
KINDS = (*NETWORKS, *LINEAR, *TREES, *GRAPHS)
#: Kinds whose prediction is a number and not a class.
REGRESSORS = ("linear_regression", "neural_network_regressor", "random_forest_regressor", "boosting_tree_regressor")

_SCHEMA = "model_id string, category string, parent_id string, train_table string, x_columns string, y_column string, definition string, params string, metrics string, save_path string, log_table string, created_at string"


@dataclass
class ModelInfo:
    """What the registry knows of a model; lists and dictionaries are kept as JSON text."""

    category: str
    x_columns: list[str]
    y_column: str | None = None
    definition: Any = None
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    train_table: str | None = None
    parent_id: str | None = None
    model_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    save_path: str = ""
    log_table: str = ""
    created_at: str = ""


class ModelRegistry:
    """Models under ``root``: <root>/info, <root>/logs/<id> and <root>/models/<id>."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save_path(self, model_id: str) -> str:
        return f"{self.root}/models/{model_id}"

    def log_path(self, model_id: str) -> str:
        return f"{self.root}/logs/{model_id}"

    def write(self, info: ModelInfo, history: list[dict] | None = None) -> str:
        """Store a model's entry and the log of its training; its id."""
        if info.category not in KINDS:
            raise ValueError(f"kind of model {info.category}; there are {', '.join(KINDS)}")
        info.save_path, info.log_table = self.save_path(info.model_id), self.log_path(info.model_id)
        info.created_at = datetime.now(UTC).isoformat()
        row = {k: json.dumps(v) if k in ("x_columns", "definition", "params", "metrics") else v for k, v in asdict(info).items()}
        names = [c.strip().split()[0] for c in _SCHEMA.split(",")]
        self.spark.createDataFrame([tuple(row[n] for n in names)], _SCHEMA).write.mode("append").parquet(f"{self.root}/info")
        log = [(i, int(h.get("batch", 0)), json.dumps({k: v for k, v in h.items() if k != "batch"}), info.created_at) for i, h in enumerate(history or [])]
        self.spark.createDataFrame(log, "epoch int, batch int, logs string, update_time string").write.mode("overwrite").parquet(info.log_table)
        return info.model_id

    def info(self, model_id: str) -> ModelInfo:
        """The entry of a model."""
        row = self.spark.read.schema(_SCHEMA).parquet(f"{self.root}/info").filter(F.col("model_id") == model_id).first()
        if row is None:
            raise KeyError(f"no model {model_id}")
        d = row.asDict()
        for k in ("x_columns", "definition", "params", "metrics"):
            d[k] = json.loads(d[k])
        return ModelInfo(**d)

    def log(self, model_id: str) -> DataFrame:
        """(epoch, batch, logs, update_time) of a training."""
        return self.spark.read.parquet(self.log_path(model_id))


def parse_pairs(text: str | None) -> dict[str, Any]:
    """'a=1,b=0.5,c=x' as a dictionary with ints and floats recognised."""
    out: dict[str, Any] = {}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        key, _, value = part.partition("=")
        for kind in (int, float, str):
            try:
                out[key.strip()] = kind(value.strip())
                break
            except ValueError:
                continue
    return out


def class_weights(text: str | None) -> dict[float, float]:
    """'0=1.0,1=2.5' as weights by class."""
    return {float(k): float(v) for k, v in parse_pairs(text).items()}
