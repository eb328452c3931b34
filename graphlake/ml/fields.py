"""Graph convolutions over sampled receptive fields, with trained weights for every hop.

The field of a vertex along a typed sample path is a tree of at most k
neighbours a hop, laid out in one row of numbers: the attributes of the vertex,
a mark that it is there, and the rows of its k neighbours, missing ones as
zeros. A field is bounded by k and the length of the path whatever the degrees,
so it is built by joins and grouped lists of at most k rows. The networks read
whole batches of fields as arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.ml.mlp import ACTIVATIONS, Network, UnsupportedLayer, _act, _act_grad
from graphlake.ml.sampling import top_neighbours
from graphlake.operators.graph import PropertyGraph
from graphlake.operators.metapath import parse_sample_paths
from graphlake.storage import Rounds

AGGREGATORS = ("mean", "sum", "max")


@dataclass(frozen=True)
class FieldSpec:
    """How a field is built: numeric attributes with their mean and deviation, looked-up ones by buckets of a hash."""

    attributes: tuple[str, ...]
    paths: tuple[str, ...]
    k: int
    weight: str | None = None
    vertex_type: str = "vtype"
    edge_type: str = "etype"
    lookups: tuple[str, ...] = ()
    buckets: int = 64
    mean: tuple[float, ...] = ()
    sd: tuple[float, ...] = ()

    @property
    def width(self) -> int:
        """Numbers of one vertex, its mark included."""
        return len(self.attributes) + len(self.lookups) + 1

    @property
    def hops(self) -> int:
        return len(parse_sample_paths(self.paths)[0][1])

    def length(self, hops: int) -> int:
        """Numbers of a field of so many hops."""
        return self.width + (self.k * self.length(hops - 1) if hops else 0)

    def scaled(self, graph: PropertyGraph) -> FieldSpec:
        """With the mean and deviation of the numeric attributes over all vertices."""
        aggs = [f(F.col(a).cast("double")).alias(f"{n}{i}") for i, a in enumerate(self.attributes) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = graph.vertices.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        mean = tuple(float(row[f"m{i}"] or 0.0) for i in range(len(self.attributes)))
        sd = tuple(float(row[f"s{i}"] or 0.0) or 1.0 for i in range(len(self.attributes)))
        return FieldSpec(self.attributes, self.paths, self.k, self.weight, self.vertex_type, self.edge_type, self.lookups, self.buckets, mean, sd)


def _own(graph: PropertyGraph, spec: FieldSpec) -> DataFrame:
    """(id, type, row): the numbers of each vertex; a null attribute is the mean, a null looked up is a value like others."""
    numeric = [F.coalesce((F.col(a).cast("double") - m) / s, F.lit(0.0)) for a, m, s in zip(spec.attributes, spec.mean, spec.sd, strict=True)]
    looked = [F.pmod(F.xxhash64(F.col(a).cast("string")), F.lit(spec.buckets)).cast("double") for a in spec.lookups]
    return graph.vertices.select("id", F.col(spec.vertex_type).alias("type"), F.array(*numeric, *looked, F.lit(1.0)).alias("row")).dropDuplicates(["id"])


def sampled_fields(graph: PropertyGraph, spec: FieldSpec) -> tuple[DataFrame, list[str]]:
    """((id, f0, f1, ...), names of the numbers): one row per vertex of the paths' first type; the paths lie side by side."""
    own, parsed = _own(graph, spec), parse_sample_paths(spec.paths)
    out = own.filter(F.col("type") == parsed[0][0]).select("id", F.lit(None).cast("array<double>").alias("field"))
    for first, steps in parsed:
        value = own.filter(F.col("type") == steps[-1].vertex_type).select("id", "row")
        for hop in range(len(steps) - 1, -1, -1):
            s, length = steps[hop], spec.length(len(steps) - 1 - hop)
            g = graph.of_type(s.edge_type, spec.edge_type)
            g = g if s.forward else g.reversed()
            ends = value.select(F.col("id").alias("dst_id"), F.col("row").alias("below"))
            # the k heaviest of those neighbours that have the type of the step
            typed = PropertyGraph(g.edges.join(ends.select("dst_id"), "dst_id", "left_semi"))
            near = top_neighbours(typed, spec.k, spec.weight).select("src_id", "dst_id", "rank").join(ends, "dst_id")
            lists = near.groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "below"))).alias("near"))
            rows = F.flatten(F.transform("near", lambda x: x["below"]))
            lists = lists.select("id", F.concat(rows, F.array_repeat(F.lit(0.0), (F.lit(spec.k) - F.size("near")) * length)).alias("near"))
            kind = steps[hop - 1].vertex_type if hop else first
            here = own.filter(F.col("type") == kind).select("id", "row").join(lists, "id", "left")
            value = here.select("id", F.concat("row", F.coalesce("near", F.array_repeat(F.lit(0.0), spec.k * length))).alias("row"))
        out = out.join(value, "id").select("id", F.when(F.col("field").isNull(), F.col("row")).otherwise(F.concat("field", "row")).alias("field"))
    n = spec.length(spec.hops) * len(spec.paths)
    names = [f"f{i}" for i in range(n)]
    written, _ = Rounds(graph.edges.sparkSession, "fields").write(out)
    return written.select("id", *(F.get("field", F.lit(i)).alias(c) for i, c in enumerate(names))), names


@dataclass
class FieldNetwork(Network):
    """A convolution a hop, then a dense layer of scores.

    ``tied`` uses one matrix for a vertex and the mean of it with its
    neighbours; otherwise the vertex and the aggregate of its neighbours have
    their own. Looked-up attributes become trained vectors of ``dim``; with
    ``wide`` the vertex's own numbers also go to the scores directly.
    """

    spec: FieldSpec | None = None
    units: tuple[int, ...] = ()
    agg: str = "mean"
    activation: str = "relu"
    tied: bool = False
    dim: int = 8
    wide: bool = False
    at: dict = field(default_factory=dict)

    @classmethod
    def make(cls, spec: FieldSpec, units: Sequence[int], classes: int, agg: str = "mean", activation: str = "relu", tied: bool = False, dim: int = 8, wide: bool = False, loss: str = "sparse_categorical_crossentropy", seed: int = 3) -> FieldNetwork:
        if agg not in AGGREGATORS:
            raise UnsupportedLayer(f"aggregator {agg}; there are {', '.join(AGGREGATORS)}")
        if activation not in ACTIVATIONS:
            raise UnsupportedLayer(f"activation {activation}")
        if len(units) != spec.hops:
            raise ValueError(f"{len(units)} sizes of layers for paths of {spec.hops} hops")
        net = cls(spec.length(spec.hops) * len(spec.paths), [("dense", {"units": classes})], loss, [], spec, tuple(units), agg, activation, tied, dim, wide)
        rng = np.random.default_rng(seed)

        def weight(key, *shape):
            lim = np.sqrt(6 / sum(shape))
            net.at[key] = len(net.params)
            net.params.append(rng.uniform(-lim, lim, shape))

        for i in range(len(spec.lookups)):
            weight(("lookup", i), spec.buckets, dim)
        first = len(spec.attributes) + dim * len(spec.lookups)
        for p in range(len(spec.paths)):
            n = first
            for layer, u in enumerate(units):
                weight(("own", p, layer), n, u)
                if not tied:
                    weight(("near", p, layer), n, u)
                net.at["bias", p, layer] = len(net.params)
                net.params.append(np.zeros(u))
                n = u
        weight("head", n if tied else n * len(spec.paths), classes)
        net.at["head_bias"] = len(net.params)
        net.params.append(np.zeros(classes))
        if wide:
            weight("wide", first, classes)
        return net

    def _p(self, *key) -> np.ndarray:
        return self.params[self.at[key if len(key) > 1 else key[0]]]

    def _encode(self, raw: np.ndarray, there: np.ndarray) -> np.ndarray:
        n = len(self.spec.attributes)
        looked = [self._p("lookup", i)[raw[:, n + i].astype(int)] for i in range(len(self.spec.lookups))]
        return np.concatenate([raw[:, :n], *looked], axis=1) * there[:, None]

    def _path(self, x: np.ndarray, p: int) -> tuple[np.ndarray, dict]:
        """The vector of the first vertex of path ``p``, and what the way back needs."""
        s, hops = self.spec, self.spec.hops
        raw, there, cur = [], [], x
        for d in range(hops + 1):
            raw.append(cur[:, : s.width - 1])
            there.append(cur[:, s.width - 1])
            cur = cur[:, s.width :].reshape(-1, s.length(hops - d - 1)) if d < hops else cur
        h = [self._encode(r, t) for r, t in zip(raw, there, strict=True)]
        tape = {"raw": raw, "there": there, "steps": [], "first": h[0]}
        for layer in range(hops):
            nxt, memo = [], []
            for d in range(hops - layer):
                own, near, mark = h[d], h[d + 1].reshape(len(h[d]), s.k, -1), there[d + 1].reshape(len(h[d]), s.k)
                n = mark.sum(axis=1)[:, None]
                if self.tied:
                    mixed = (own + near.sum(axis=1)) / (1 + n)
                    z, arg = mixed @ self._p("own", p, layer), None
                elif self.agg == "max":
                    low = np.where(mark[:, :, None] > 0, near, -np.inf)
                    arg = low.argmax(axis=1)
                    mixed = np.where(n > 0, np.take_along_axis(near, arg[:, None, :], axis=1)[:, 0], 0.0)
                else:
                    arg = None
                    mixed = near.sum(axis=1) / (np.maximum(n, 1) if self.agg == "mean" else 1)
                if not self.tied:
                    z = own @ self._p("own", p, layer) + mixed @ self._p("near", p, layer)
                z = z + self._p("bias", p, layer)
                a = _act(self.activation, z)
                memo.append((own, mixed, n, arg, z, a))
                nxt.append(a * there[d][:, None])
            tape["steps"].append(memo)
            h = nxt
        return h[0], tape

    def _back(self, g: np.ndarray, p: int, tape: dict, grads: list[np.ndarray]) -> None:
        s, hops, there = self.spec, self.spec.hops, tape["there"]
        down: list[np.ndarray | None] = [g]
        for layer in range(hops - 1, -1, -1):
            memo = tape["steps"][layer]
            width = memo[0][0].shape[1]
            below: list[np.ndarray] = [np.zeros((len(there[d]), width)) for d in range(hops - layer + 1)]
            for d in range(hops - layer):
                own, mixed, n, arg, z, a = memo[d]
                gz = _act_grad(self.activation, z, a, down[d] * there[d][:, None])
                grads[self.at["bias", p, layer]] += gz.sum(axis=0)
                grads[self.at["own", p, layer]] += (mixed if self.tied else own).T @ gz
                back = gz @ self._p("own", p, layer).T
                spread = below[d + 1].reshape(len(own), s.k, width)
                mark = there[d + 1].reshape(len(own), s.k)[:, :, None]
                if self.tied:
                    below[d] += back / (1 + n)
                    spread += (back / (1 + n))[:, None, :] * mark
                    continue
                below[d] += back
                grads[self.at["near", p, layer]] += mixed.T @ gz
                far = gz @ self._p("near", p, layer).T
                if self.agg == "max":
                    np.put_along_axis(spread, arg[:, None, :], np.take_along_axis(spread, arg[:, None, :], axis=1) + np.where(n > 0, far, 0.0)[:, None, :], axis=1)
                else:
                    spread += (far / (np.maximum(n, 1) if self.agg == "mean" else 1))[:, None, :] * mark
            down = below
        for d in range(hops + 1):
            self._back_lookup(down[d], tape["raw"][d], there[d], grads)

    def _back_lookup(self, g: np.ndarray, raw: np.ndarray, there: np.ndarray, grads: list[np.ndarray]) -> None:
        n = len(self.spec.attributes)
        for i in range(len(self.spec.lookups)):
            part = g[:, n + i * self.dim : n + (i + 1) * self.dim] * there[:, None]
            np.add.at(grads[self.at["lookup", i]], raw[:, n + i].astype(int), part)

    def embed(self, x: np.ndarray) -> np.ndarray:
        """The vectors before the scores."""
        return self._both(x)[0]

    def _both(self, x: np.ndarray) -> tuple[np.ndarray, list[dict]]:
        one = self.spec.length(self.spec.hops)
        got = [self._path(x[:, p * one : (p + 1) * one], p) for p in range(len(self.spec.paths))]
        v = sum(h for h, _ in got) if self.tied else np.concatenate([h for h, _ in got], axis=1)
        return v, [t for _, t in got]

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        v, tapes = self._both(x)
        out = v @ self._p("head") + self._p("head_bias")
        if self.wide:
            out = out + tapes[0]["first"] @ self._p("wide")
        return out, [v, tapes]

    def gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], float]:
        out, (v, tapes) = self.forward(x)
        value, g = self.loss_of(out, y, w)
        grads = [np.zeros_like(p) for p in self.params]
        grads[self.at["head"]], grads[self.at["head_bias"]] = v.T @ g, g.sum(axis=0)
        gv = g @ self._p("head").T
        size = self.units[-1]
        for p, tape in enumerate(tapes):
            self._back(gv if self.tied else gv[:, p * size : (p + 1) * size], p, tape, grads)
        if self.wide:
            first = tapes[0]
            grads[self.at["wide"]] = first["first"].T @ g
            self._back_lookup(g @ self._p("wide").T, first["raw"][0], first["there"][0], grads)
        return grads, value


def best(scores: str | Column) -> Column:
    """The class of the greatest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
