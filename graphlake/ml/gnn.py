"""Graph networks: trained convolutions over sampled fields, and propagated features where all neighbours count.

A receptive field follows typed sample paths. Sampled networks (``fields``)
train weights for every hop. With all neighbours a field has no bound, so its
attributes are folded to one vector a vertex by grouped averages, hop by hop
from the far end, and a dense head is trained on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.ml.fields import FieldNetwork, FieldSpec, best, sampled_fields
from graphlake.ml.mlp import Network, evaluate_network, predict_network
from graphlake.ml.registry import GRAPHS
from graphlake.ml.sampling import negative_samples, top_neighbours
from graphlake.ml.tabular import VALID_SHARE, Tables
from graphlake.operators.graph import PropertyGraph
from graphlake.operators.metapath import parse_sample_paths
from graphlake.storage import Rounds

AGGREGATORS = {"mean": F.avg, "sum": F.sum, "max": F.max}


def propagate(graph: PropertyGraph, attributes: Sequence[str], paths: Sequence[str], k: int | None = None, weight: str | None = None, agg: str = "mean", vertex_type: str = "vtype", edge_type: str = "etype", concat: bool = True, mean: Sequence[float] | None = None, sd: Sequence[float] | None = None) -> tuple[DataFrame, list[str]]:
    """((id, features...), names): the attributes of a vertex and of what it meets along the sample paths.

    ``k`` keeps the heaviest edges a hop; ``concat=False`` adds the hops to
    the vertex's own attributes in place of new columns. Vertices that meet
    nothing have 0 there. A hop is an average of averages, so a field is
    never listed, however large. ``mean`` and ``sd`` standardise the attributes.
    """
    if agg not in AGGREGATORS:
        raise ValueError(f"aggregator {agg}; there are {', '.join(AGGREGATORS)}")
    fold = AGGREGATORS[agg]
    parsed = parse_sample_paths(paths)
    scaled = [F.coalesce((F.col(a).cast("double") - m) / s, F.lit(0.0)).alias(a) for a, m, s in zip(attributes, mean or [0.0] * len(attributes), sd or [1.0] * len(attributes), strict=True)]
    own = graph.vertices.select("id", vertex_type, *scaled).dropDuplicates(["id"])
    out = own.filter(F.col(vertex_type) == parsed[0][0]).select("id", *attributes)
    names = list(attributes)
    for p, (_, steps) in enumerate(parsed):
        for depth in range(1, len(steps) + 1):
            # from the far end of this depth back to the start
            value = own.filter(F.col(vertex_type) == steps[depth - 1].vertex_type).select("id", *attributes)
            for s in reversed(steps[:depth]):
                g = graph.of_type(s.edge_type, edge_type)
                g = g if s.forward else g.reversed()
                if k is not None:
                    g = PropertyGraph(top_neighbours(g, k, weight))
                met = g.links().join(value.withColumnRenamed("id", "dst_id"), "dst_id")
                value = met.groupBy(F.col("src_id").alias("id")).agg(*(fold(a).alias(a) for a in attributes))
            cols = [f"p{p}h{depth}_{a}" for a in attributes]
            out = out.join(value.select("id", *(F.col(a).alias(c) for a, c in zip(attributes, cols, strict=True))), "id", "left")
            out = out.select("id", *names, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in cols))
            names += cols
    if not concat:
        hops = [n for n in names if n not in attributes]
        out = out.select("id", *((F.col(a) + sum((F.col(h) for h in hops if h.endswith(f"_{a}")), F.lit(0.0))).alias(a) for a in attributes))
        names = list(attributes)
    return out, names


class GraphModels:
    """Graph networks of one registry of table models."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def _labelled(self, features: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, int]:
        rows, seen = Rounds(labels.sparkSession, "gnn").write(features.join(labels.select("id", F.col(label).cast("int").alias("label")).filter("label is not null"), "id"), top=F.max("label"))
        return rows, (seen["top"] or 0) + 1

    def _train_field(self, graph: PropertyGraph, labels: DataFrame, spec: FieldSpec, label: str, hidden: Sequence[int] | None, category: str, net_options: dict, epochs: int = 5, batch_size: int = 256, rate: float = 0.01, passes: int = 1, optimizer: str = "adam", class_weight: dict | None = None, valid_share: float = VALID_SHARE) -> str:
        spec = spec.scaled(graph)
        fields, names = sampled_fields(graph, spec)
        rows, classes = self._labelled(fields, labels, label)
        units = list(hidden) if hidden else [32] * spec.hops
        net = FieldNetwork.make(spec, units, max(classes, 2), **net_options)
        extra = {"field": asdict(spec), "units": units, **net_options}
        return self.tables._fit(net, rows, names, "label", [], optimizer, rate, epochs, batch_size, class_weight, valid_share, category, None, passes, extra)

    def train_full_gcn(self, graph: PropertyGraph, labels: DataFrame, attributes: Sequence[str], paths: Sequence[str], label: str = "label", hidden: Sequence[int] = (32,), epochs: int = 5, batch_size: int = 256, rate: float = 0.01, passes: int = 1, **how) -> str:
        """All neighbours of every hop, summed over paths, under a dense head."""
        scale = FieldSpec(tuple(attributes), tuple(paths), 1).scaled(graph)
        how = {**how, "mean": list(scale.mean), "sd": list(scale.sd)}
        features, names = propagate(graph, attributes, paths, concat=False, **how)
        rows, classes = self._labelled(features, labels, label)
        layers = [*(("dense", {"units": h, "activation": "relu"}) for h in hidden), ("dense", {"units": classes})]
        net = Network.build(len(names), layers, "sparse_categorical_crossentropy")
        extra = {"attributes": list(attributes), "paths": list(paths), "how": how}
        return self.tables._fit(net, rows, names, "label", layers, "adam", rate, epochs, batch_size, None, VALID_SHARE, "full_gcn", None, passes, extra)

    def train_sampled_gcn(self, graph: PropertyGraph, labels: DataFrame, attributes: Sequence[str], paths: Sequence[str], k: int, label: str = "label", hidden: Sequence[int] | None = None, weight: str | None = None, vertex_type: str = "vtype", edge_type: str = "etype", lookups: Sequence[str] = (), **head) -> str:
        """The ``k`` heaviest neighbours of a hop; a vertex is mixed with them before one matrix a hop. Paths are summed."""
        spec = FieldSpec(tuple(attributes), tuple(paths), k, weight, vertex_type, edge_type, tuple(lookups))
        return self._train_field(graph, labels, spec, label, hidden, "sampled_gcn", {"tied": True}, **head)

    def train_supervised_sage(self, graph: PropertyGraph, labels: DataFrame, attributes: Sequence[str], paths: Sequence[str], k: int, label: str = "label", hidden: Sequence[int] | None = None, weight: str | None = None, vertex_type: str = "vtype", edge_type: str = "etype", lookups: Sequence[str] = (), agg: str = "mean", wide: bool = False, **head) -> str:
        """A vertex and the mean, sum or max of its ``k`` heaviest neighbours, each with a matrix a hop. Paths lie side by side."""
        spec = FieldSpec(tuple(attributes), tuple(paths), k, weight, vertex_type, edge_type, tuple(lookups))
        return self._train_field(graph, labels, spec, label, hidden, "supervised_sage", {"agg": agg, "wide": wide}, **head)

    def _rows(self, model_id: str, graph: PropertyGraph) -> tuple[DataFrame, list[str]]:
        """What the model reads of each vertex of its first type."""
        info = self.tables.registry.info(model_id)
        if info.category == "full_gcn":
            return propagate(graph, info.params["attributes"], info.params["paths"], concat=False, **info.params["how"])
        if info.category not in GRAPHS or "field" not in info.params:
            raise ValueError(f"{info.category} is no graph network")
        spec = FieldSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in info.params["field"].items()})
        return sampled_fields(graph, spec)

    def predict(self, model_id: str, graph: PropertyGraph, result_type: str = "class") -> DataFrame:
        """(id, predict) of all vertices of the model's first type: a class, or an array with 'logit', 'probability' or 'embedding'."""
        if result_type not in ("class", "logit", "probability", "embedding"):
            raise ValueError(f"result type {result_type}; there are class, logit, probability, embedding")
        rows, names = self._rows(model_id, graph)
        net = self.tables._network(model_id)
        if result_type == "embedding" and not hasattr(net, "embed"):
            return rows.select("id", F.array(*names).alias("predict"))
        out = predict_network(net, rows, names, ["id"], result_type == "embedding")
        if result_type == "class":
            return out.select("id", best("scores").alias("predict"))
        if result_type == "probability":
            powers = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
            return out.select("id", powers.alias("p")).select("id", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)).alias("predict"))
        return out.select("id", F.col("scores").alias("predict"))

    def evaluate(self, model_id: str, graph: PropertyGraph, labels: DataFrame, label: str = "label", metrics: Sequence[str] = ("loss", "accuracy")) -> list[float]:
        """Values of the metrics over the labelled vertices."""
        rows, names = self._rows(model_id, graph)
        data, _ = self._labelled(rows, labels, label)
        return evaluate_network(self.tables._network(model_id), data, names, "label", metrics)


def unsupervised_sage(graph: PropertyGraph, attributes: Sequence[str], paths: Sequence[str], positive_path: str, k: int | None = None, neg_num: int = 2, seed: int = 7, vertex_type: str = "vtype", edge_type: str = "etype", **how) -> DataFrame:
    """(id, embedding): propagated features scaled so that vertices met on a walk have a high product and drawn ones a low one.

    Positive pairs are the ends of random walks along ``positive_path``, which
    leads back to its first type; negative ones are drawn evenly. The scales are the square roots of a logistic model's weights, kept from
    falling below 0, over products of features.
    """
    types = {"vertex_type": vertex_type, "edge_type": edge_type}
    features, names = propagate(graph, attributes, paths, k, **types, **how)
    store = Rounds(graph.edges.sparkSession, "sage")
    features, _ = store.write(features)
    positive = features.select(F.col("id").alias("a"), F.col("id").alias("b"))
    for i, step in enumerate(parse_sample_paths([positive_path])[0][1]):
        g = graph.of_type(step.edge_type, edge_type)
        g = g if step.forward else g.reversed()
        # the walks of one vertex part ways by a hash of their start
        options = g.links().join(graph.vertices.filter(F.col(vertex_type) == step.vertex_type).select(F.col("id").alias("dst_id")).distinct(), "dst_id", "left_semi")
        met = positive.join(options.withColumnRenamed("src_id", "b"), "b")
        positive = met.groupBy("a").agg(F.min_by("dst_id", F.xxhash64("a", "dst_id", F.lit(seed + i))).alias("b"))
    positive = positive.filter("a <> b").select("a", "b", F.lit(1.0).alias("label"))
    starts = PropertyGraph(features.select(F.col("id").alias("src_id"), F.col("id").alias("dst_id")))
    negative = negative_samples(starts, neg_num, seed).select(F.col("src_id").alias("a"), F.col("neg_id").alias("b"), F.lit(0.0).alias("label"))
    left, right = features.select(F.col("id").alias("a"), *(F.col(n).alias(f"l_{n}") for n in names)), features.select(F.col("id").alias("b"), *(F.col(n).alias(f"r_{n}") for n in names))
    pairs = positive.unionAll(negative).join(left, "a").join(right, "b").select("label", *((F.col(f"l_{n}") * F.col(f"r_{n}")).alias(n) for n in names))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(pairs)
    model = LogisticRegression(maxIter=20, lowerBoundsOnCoefficients=Matrices.dense(1, len(names), [0.0] * len(names)), family="binomial").fit(rows)
    scale = [float(w) ** 0.5 for w in model.coefficients]
    return features.select("id", F.array(*(F.col(n) * F.lit(s) for n, s in zip(names, scale, strict=True))).alias("embedding"))
