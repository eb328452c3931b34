"""Dense networks in numpy, trained where the rows are.

An epoch sends the weights to the tasks; each task runs mini-batches over its
own rows and returns one set of weights with the number of its rows, and these
are averaged in two stages, so that no more than a few hundred sets meet on
the driver. Steps and moments of the optimizer are averaged along with them and
go on in the next epoch. Rows never move.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnsupportedLayer(ValueError):
    """A layer, loss or optimizer by a known name that is not built here."""


ACTIVATIONS = ("linear", "relu", "tanh", "sigmoid", "softmax", "elu", "leakyrelu", "selu", "softplus")
LAYERS = ("dense", "activation", "dropout", "batchnormalization", "relu", "leakyrelu", "elu", "softmax")
LOSSES = (
    "mse", "mae", "binary_crossentropy", "categorical_crossentropy", "sparse_categorical_crossentropy", "hinge", "huber", "logcosh",
    "msle", "squared_hinge", "categorical_hinge", "kld", "poisson", "cosine_similarity",
)
#: Losses that may grow without bound where a target is 0.
RELATIVE_LOSSES = ("mape",)
_LONG_NAMES = {
    "mean_squared_error": "mse", "mean_absolute_error": "mae", "mean_absolute_percentage_error": "mape", "mean_squared_logarithmic_error": "msle",
    "kullback_leibler_divergence": "kld", "kl_divergence": "kld", "log_cosh": "logcosh", "cosine": "cosine_similarity", "root_mean_squared_error": "rmse",
}
OPTIMIZERS = ("sgd", "adam", "rmsprop", "adagrad", "adadelta", "adamax", "nadam", "ftrl")
METRICS = (
    "loss", "mse", "mae", "rmse", "accuracy", "binary_accuracy", "sparse_categorical_accuracy", "mape", "cosine", "msle", "logcosh", "hinge", "squared_hinge", "poisson", "kld",
    "binary_crossentropy", "sparse_top_k_categorical_accuracy", "precision", "recall", "f1", "true_positives", "false_positives", "true_negatives", "false_negatives", "mean", "sum",
)


def _act(name: str, z: np.ndarray) -> np.ndarray:
    if name == "relu":
        return np.maximum(z, 0)
    if name == "leakyrelu":
        return np.where(z > 0, z, 0.3 * z)
    if name == "elu":
        return np.where(z > 0, z, np.expm1(np.minimum(z, 0)))
    if name == "selu":
        return 1.0507009873554805 * np.where(z > 0, z, 1.6732632423543772 * np.expm1(np.minimum(z, 0)))
    if name == "softplus":
        return np.logaddexp(0, z)
    if name == "tanh":
        return np.tanh(z)
    if name == "sigmoid":
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    if name == "softmax":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return z


def _act_grad(name: str, z: np.ndarray, a: np.ndarray, g: np.ndarray) -> np.ndarray:
    if name == "relu":
        return g * (z > 0)
    if name == "leakyrelu":
        return g * np.where(z > 0, 1, 0.3)
    if name == "elu":
        return g * np.where(z > 0, 1, a + 1)
    if name == "selu":
        return g * np.where(z > 0, 1.0507009873554805, a + 1.0507009873554805 * 1.6732632423543772)
    if name == "softplus":
        return g / (1 + np.exp(-np.clip(z, -60, 60)))
    if name == "tanh":
        return g * (1 - a * a)
    if name == "sigmoid":
        return g * a * (1 - a)
    if name == "softmax":
        return a * (g - (g * a).sum(axis=1, keepdims=True))
    return g


@dataclass
class Network:
    """Layers as (kind, options); parameters as a list of arrays in layer order."""

    inputs: int
    layers: list[tuple[str, dict]]
    loss: str = "mse"
    params: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, inputs: int, layers_def: Sequence[tuple[str, str | dict]], loss: str = "mse", seed: int = 3) -> Network:
        """From names and options such as ("dense", "units=32,activation=tanh")."""
        from graphlake.ml.registry import parse_pairs

        layers: list[tuple[str, dict]] = []
        for name, opts in layers_def:
            kind = name.lower()
            if kind not in LAYERS:
                raise UnsupportedLayer(f"layer {name}; there are {', '.join(LAYERS)}")
            o = dict(opts) if isinstance(opts, dict) else parse_pairs(opts)
            if o.get("activation", "linear") not in ACTIVATIONS:
                raise UnsupportedLayer(f"activation {o['activation']}")
            layers.append((kind, o))
        loss = _LONG_NAMES.get(loss.lower(), loss.lower())
        if loss not in (*LOSSES, *RELATIVE_LOSSES):
            raise UnsupportedLayer(f"loss {loss}; there are {', '.join((*LOSSES, *RELATIVE_LOSSES))}")
        rng, n, params = np.random.default_rng(seed), inputs, []
        for kind, o in layers:
            if kind == "dense":
                units = int(o["units"])
                lim = np.sqrt(6 / (n + units))
                params += [rng.uniform(-lim, lim, (n, units)), np.zeros(units)]
                n = units
            elif kind == "batchnormalization":
                # scale, shift, and the running mean and variance that prediction uses
                params += [np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)]
        return cls(inputs, layers, loss, params)

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Outputs, and what the way back needs; dropout only with a generator."""
        tape, p = [], 0
        for kind, o in self.layers:
            if kind == "dense":
                w, b = self.params[p], self.params[p + 1]
                z = x @ w + b
                name = o.get("activation", "linear")
                a = _act(name, z)
                tape.append(("dense", p, x, z, a, name))
                x, p = a, p + 2
            elif kind == "batchnormalization":
                if rng is not None and len(x) > 1:
                    mu, var = x.mean(axis=0), x.var(axis=0)
                    keep = float(o.get("momentum", 0.9))
                    self.params[p + 2] = keep * self.params[p + 2] + (1 - keep) * mu
                    self.params[p + 3] = keep * self.params[p + 3] + (1 - keep) * var
                    by_batch = True
                else:
                    mu, var, by_batch = self.params[p + 2], self.params[p + 3], False
                sd = np.sqrt(var + 1e-3)
                h = (x - mu) / sd
                tape.append(("bn", p, h, sd, by_batch, None))
                x, p = h * self.params[p] + self.params[p + 1], p + 4
            elif kind == "dropout":
                keep = 1 - float(o.get("rate", 0.5))
                mask = (rng.random(x.shape) < keep) / keep if rng is not None else np.ones_like(x)
                tape.append(("mask", None, mask, None, None, None))
                x = x * mask
            else:
                name = o.get("activation", "linear") if kind == "activation" else kind
                a = _act(name, x)
                tape.append(("act", None, None, x, a, name))
                x = a
        return x, tape

    def gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], float]:
        out, tape = self.forward(x, rng)
        value, g = self.loss_of(out, y, w)
        grads = [np.zeros_like(p) for p in self.params]
        for kind, p, a0, z, a, name in reversed(tape):
            if kind == "dense":
                g = _act_grad(name, z, a, g)
                grads[p], grads[p + 1] = a0.T @ g, g.sum(axis=0)
                g = g @ self.params[p].T
            elif kind == "bn":
                grads[p], grads[p + 1] = (g * a0).sum(axis=0), g.sum(axis=0)
                g = g * self.params[p]
                if a:  # the mean and the variance of the batch depend on the row too
                    g = g - g.mean(axis=0) - a0 * (g * a0).mean(axis=0)
                g = g / z
            elif kind == "mask":
                g = g * a0
            else:
                g = _act_grad(name, z, a, g)
        return grads, value

    def loss_of(self, out: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        n = max(float(w.sum()), 1e-12)
        wc = w[:, None]
        if self.loss == "sparse_categorical_crossentropy":
            # scores without a softmax layer are logits
            last = self.layers[-1]
            soft = out if "softmax" in (last[0], last[1].get("activation")) else _act("softmax", out)
            i = y.astype(int)
            value = -np.log(np.clip(soft[np.arange(len(i)), i], 1e-12, 1))
            g = soft.copy()
            g[np.arange(len(i)), i] -= 1
            if soft is out:
                g = np.zeros_like(out)
                g[np.arange(len(i)), i] = -1 / np.clip(out[np.arange(len(i)), i], 1e-12, 1)
            return float((value * w).sum() / n), g * wc / n
        t = y.reshape(len(y), -1).astype(float)
        d = out - t
        if self.loss == "mse":
            v, g = (d * d).mean(axis=1), 2 * d / d.shape[1]
        elif self.loss == "mae":
            v, g = np.abs(d).mean(axis=1), np.sign(d) / d.shape[1]
        elif self.loss == "huber":
            small = np.abs(d) <= 1
            v, g = np.where(small, d * d / 2, np.abs(d) - 0.5).mean(axis=1), np.clip(d, -1, 1) / d.shape[1]
        elif self.loss == "logcosh":
            v, g = (np.logaddexp(d, -d) - np.log(2)).mean(axis=1), np.tanh(d) / d.shape[1]
        elif self.loss == "hinge":
            s = np.where(t > 0, 1.0, -1.0)
            m = 1 - s * out
            v, g = np.maximum(m, 0).mean(axis=1), np.where(m > 0, -s, 0.0) / d.shape[1]
        elif self.loss == "squared_hinge":
            s = np.where(t > 0, 1.0, -1.0)
            m = np.maximum(1 - s * out, 0)
            v, g = (m * m).mean(axis=1), -2 * s * m / d.shape[1]
        elif self.loss == "categorical_hinge":
            wrong = (1 - t) * out
            m = wrong.max(axis=1) - (t * out).sum(axis=1) + 1
            first = np.arange(out.shape[1]) == wrong.argmax(axis=1)[:, None]
            v, g = np.maximum(m, 0), np.where(m[:, None] > 0, first * (1 - t) - t, 0.0)
        elif self.loss == "mape":
            base = np.maximum(np.abs(t), 1e-7)
            v, g = 100 * (np.abs(d) / base).mean(axis=1), 100 * np.sign(d) / base / d.shape[1]
        elif self.loss == "msle":
            o = np.maximum(out, 1e-7)
            e = np.log1p(o) - np.log1p(np.maximum(t, 1e-7))
            v, g = (e * e).mean(axis=1), np.where(out > 1e-7, 2 * e / (1 + o), 0.0) / d.shape[1]
        elif self.loss == "poisson":
            o = np.maximum(out, 1e-7)
            v, g = (out - t * np.log(o)).mean(axis=1), (1 - np.where(out > 1e-7, t / o, 0.0)) / d.shape[1]
        elif self.loss == "kld":
            o, u = np.clip(out, 1e-7, 1), np.clip(t, 1e-7, 1)
            v, g = (u * np.log(u / o)).sum(axis=1), np.where((out > 1e-7) & (out < 1), -u / o, 0.0)
        elif self.loss == "cosine_similarity":
            lo, lt = (np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12) for x in (out, t))
            c = (out * t).sum(axis=1, keepdims=True) / (lo * lt)
            v, g = -c[:, 0], -(t / (lo * lt) - c * out / (lo * lo))
        else:
            o = np.clip(out, 1e-7, 1 - 1e-7)
            if self.loss == "binary_crossentropy":
                v, g = -(t * np.log(o) + (1 - t) * np.log(1 - o)).mean(axis=1), (o - t) / (o * (1 - o)) / d.shape[1]
            else:
                v, g = -(t * np.log(o)).sum(axis=1), -t / o
        return float((v * w).sum() / n), g * wc / n


def _optimize(net: Network, grads: list[np.ndarray], state: dict, kind: str, rate: float) -> None:
    state["t"] = state.get("t", 0) + 1
    for i, g in enumerate(grads):
        if kind == "sgd":
            net.params[i] = net.params[i] - rate * g
            continue
        m, v = state.setdefault(i, [np.zeros_like(g), np.zeros_like(g)])
        if kind == "adam":
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            step = (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-7)
        elif kind == "rmsprop":
            v[:] = 0.9 * v + 0.1 * g * g
            step = g / (np.sqrt(v) + 1e-7)
        elif kind == "nadam":
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            ahead = (0.9 * m + 0.1 * g) / (1 - 0.9 ** state["t"])
            step = ahead / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-7)
        elif kind == "adamax":
            m[:] = 0.9 * m + 0.1 * g
            v[:] = np.maximum(0.999 * v, np.abs(g))
            step = m / ((1 - 0.9 ** state["t"]) * (v + 1e-7))
        elif kind == "adadelta":
            v[:] = 0.95 * v + 0.05 * g * g
            step = g * np.sqrt(m + 1e-7) / np.sqrt(v + 1e-7)
            m[:] = 0.95 * m + 0.05 * step * step
        elif kind == "ftrl":
            before = np.sqrt(v)
            v += g * g
            m += g - (np.sqrt(v) - before) / rate * net.params[i]
            net.params[i] = np.where(v > 0, -rate * m / np.maximum(np.sqrt(v), 1e-12), net.params[i])
            continue
        else:
            v += g * g
            step = g / (np.sqrt(v) + 1e-7)
        net.params[i] = net.params[i] - rate * step


def doubles(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns as doubles, those that are doubles as they stand.

    Above a filter over many columns, each that is named anew, be it to the
    same name, makes the optimizer double its constraints.
    """
    kinds = dict(df.dtypes)
    return [F.col(c) if kinds.get(c) == "double" else F.col(c).cast("double").alias(c) for c in names]


def _flat(net: Network, state: dict) -> list[np.ndarray]:
    """The weights and behind them the optimizer's steps and moments, all of which may be averaged."""
    moments = [x for i, p in enumerate(net.params) for x in state.get(i, (np.zeros_like(p), np.zeros_like(p)))]
    return [*net.params, np.array(float(state.get("t", 0))), *moments]


def _unflat(net: Network, arrays: list[np.ndarray]) -> dict:
    """Sets the weights of ``_flat`` and returns the optimizer's state."""
    k = len(net.params)
    net.params = arrays[:k]
    moments = arrays[k + 1 :]
    return {"t": int(round(float(arrays[k]))), **{i: [moments[2 * i], moments[2 * i + 1]] for i in range(k)}}


def train_network(net: Network, rows: DataFrame, x_columns: Sequence[str], y_column: str, epochs: int = 10, batch_size: int = 1024, optimizer: str = "adam", rate: float = 0.001, class_weight: dict[float, float] | None = None, valid: DataFrame | None = None, passes: int = 1, seed: int = 5) -> list[dict]:
    """Train in place; a record of loss, and of validation loss, for each epoch. Rows with a null are left out."""
    if optimizer not in OPTIMIZERS:
        raise UnsupportedLayer(f"optimizer {optimizer}; there are {', '.join(OPTIMIZERS)}")
    data = rows.select(*doubles(rows, x_columns), F.col(y_column).cast("double").alias("_y")).na.drop().persist()
    n_x, history = len(x_columns), []
    carried: dict = {}
    try:
        for epoch in range(epochs):
            blob = pickle.dumps((net, carried))

            def local(batches: Iterator[pd.DataFrame], blob=blob, epoch=epoch) -> Iterator[pd.DataFrame]:
                m, state = pickle.loads(blob)
                rng, total, count = np.random.default_rng([seed, epoch]), 0.0, 0
                for pdf in batches:
                    a = pdf.to_numpy(dtype=float)
                    for _ in range(passes):
                        rng.shuffle(a)
                        for i in range(0, len(a), batch_size):
                            x, y = a[i : i + batch_size, :n_x], a[i : i + batch_size, n_x]
                            w = np.vectorize(lambda v: class_weight.get(v, 1.0), otypes=[float])(y) if class_weight else np.ones(len(y))
                            grads, value = m.gradients(x, y, w, rng)
                            _optimize(m, grads, state, optimizer, rate)
                            total, count = total + value * len(y), count + len(y)
                if count:
                    yield pd.DataFrame({"n": [float(count)], "loss": [total], "params": [pickle.dumps([p * count for p in _flat(m, state)])]})

            def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                n, loss, params = 0.0, 0.0, None
                for pdf in batches:
                    for r in pdf.itertuples(index=False):
                        mine = pickle.loads(r.params)
                        params = mine if params is None else [p + q for p, q in zip(params, mine, strict=True)]
                        n, loss = n + r.n, loss + r.loss
                if params is not None:
                    yield pd.DataFrame({"n": [n], "loss": [loss], "params": [pickle.dumps(params)]})

            schema = "n double, loss double, params binary"
            parts = data.mapInPandas(local, schema)
            few = max(1, int(data.rdd.getNumPartitions() ** 0.5))
            got = parts.repartition(few).mapInPandas(fold, schema).collect()
            if not got:
                raise ValueError("no rows to train on")
            n = sum(r["n"] for r in got)
            sums = [pickle.loads(r["params"]) for r in got]
            carried = _unflat(net, [sum(s[i] for s in sums) / n for i in range(len(sums[0]))])
            record = {"loss": sum(r["loss"] for r in got) / n}
            if valid is not None:
                record["val_loss"] = evaluate_network(net, valid, x_columns, y_column, ["loss"])[0]
            history.append(record)
    finally:
        data.unpersist()
    return history


def predict_network(net: Network, rows: DataFrame, x_columns: Sequence[str], keep: Sequence[str], embed: bool = False) -> DataFrame:
    """The kept columns with ``scores``, the outputs (or the vectors before them) as an array; null where an input is null."""
    blob, names = pickle.dumps(net), list(keep)
    src = rows.select(*names, F.array(*(F.col(c).cast("double") for c in x_columns)).alias("_x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(blob)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf["_x"]])
            out = m.embed(np.nan_to_num(x)) if embed else m.forward(np.nan_to_num(x))[0]
            bad = np.isnan(x).any(axis=1)
            yield pdf[names].assign(scores=[None if b else o.tolist() for o, b in zip(out, bad, strict=True)])

    return src.mapInPandas(run, f"{kinds}, scores array<double>" if kinds else "scores array<double>")


def _first_output(loss: str, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of a loss of one output, a row each."""
    one = Network(1, [("dense", {})], loss)
    return np.array([one.loss_of(o.reshape(1, 1), t.reshape(1), np.ones(1))[0] for o, t in zip(first, y, strict=True)])


#: Metrics that are the mean of a loss over the first output.
_AS_LOSS = ("msle", "logcosh", "hinge", "squared_hinge", "poisson", "kld", "binary_crossentropy")


def evaluate_network(net: Network, rows: DataFrame, x_columns: Sequence[str], y_column: str, metrics: Sequence[str]) -> list[float]:
    """Values of "loss" and metric names over all rows; sums are folded where the rows are. Rows with a null are left out.

    Of several outputs the greatest is the class; of one, 1 stands for more
    than a half. Precision and its like take every class but 0 as positive;
    the best five count for top k.
    """
    wanted = [_LONG_NAMES.get(m.lower(), m.lower()) for m in metrics]
    wanted = ["cosine" if m == "cosine_similarity" else m for m in wanted]
    missing = [m for m in wanted if m not in METRICS]
    if missing:
        raise UnsupportedLayer(f"metrics {missing}; there are {', '.join(METRICS)}")
    blob, n_x, extra = pickle.dumps(net), len(x_columns), [m for m in _AS_LOSS if m in wanted]
    data = rows.select(*(F.col(c).cast("double") for c in x_columns), F.col(y_column).cast("double").alias("_y")).na.drop()
    cols = ("n", "loss", "sq", "ab", "hit", "top", "pe", "dot", "oo", "yy", "tp", "fp", "tn", "fn", "sum", *extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(blob)
        s = dict.fromkeys(cols, 0.0)
        for pdf in batches:
            a = pdf.to_numpy(dtype=float)
            if not len(a):
                continue
            y = a[:, n_x]
            out, _ = m.forward(a[:, :n_x])
            s["n"] += len(a)
            s["loss"] += m.loss_of(out, y, np.ones(len(a)))[0] * len(a)
            first = out[:, 0]
            label = out.argmax(axis=1) if out.shape[1] > 1 else (first > 0.5).astype(int)
            s["hit"] += float((label == y).sum())
            s["top"] += float((np.argsort(-out, axis=1)[:, :5] == y[:, None]).any(axis=1).sum())
            for name, hit in (("tp", (label > 0) & (y > 0)), ("fp", (label > 0) & (y <= 0)), ("tn", (label <= 0) & (y <= 0)), ("fn", (label <= 0) & (y > 0))):
                s[name] += float(hit.sum())
            s["sq"], s["ab"], s["sum"] = s["sq"] + float(((first - y) ** 2).sum()), s["ab"] + float(np.abs(first - y).sum()), s["sum"] + float(first.sum())
            s["pe"] += float((np.abs(first - y) / np.maximum(np.abs(y), 1e-7)).sum())
            s["dot"], s["oo"], s["yy"] = s["dot"] + float(first @ y), s["oo"] + float(first @ first), s["yy"] + float(y @ y)
            for name in extra:
                s[name] += float(_first_output(name, first, y).sum())
        yield pd.DataFrame({k: [v] for k, v in s.items()})

    t = data.mapInPandas(run, ", ".join(f"`{c}` double" for c in cols)).agg(*(F.sum(c).alias(c) for c in cols)).first()
    n = t["n"] or float("nan")
    known = {"loss": t["loss"] / n, "mse": t["sq"] / n, "rmse": (t["sq"] / n) ** 0.5, "mae": t["ab"] / n, "mape": 100 * t["pe"] / n, "cosine": t["dot"] / max((t["oo"] * t["yy"]) ** 0.5, 1e-12)}
    known |= dict.fromkeys(("accuracy", "binary_accuracy", "sparse_categorical_accuracy"), t["hit"] / n)
    p, r = t["tp"] / max(t["tp"] + t["fp"], 1.0), t["tp"] / max(t["tp"] + t["fn"], 1.0)
    known |= {"sparse_top_k_categorical_accuracy": t["top"] / n, "precision": p, "recall": r, "f1": 2 * p * r / max(p + r, 1e-12), "mean": t["sum"] / n, "sum": t["sum"]}
    known |= {"true_positives": t["tp"], "false_positives": t["fp"], "true_negatives": t["tn"], "false_negatives": t["fn"]} | {k: t[k] / n for k in extra}
    return [float(known[m]) for m in wanted]
