"""Vectors of vertices trained on edges, the part that one task does. Tasks import this file, so it needs little."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Edges that are looked up at once, samples of a step at most, and samples of an edge that are mixed with others at once.
CHUNK, STEP, MIXED = 1 << 17, 1 << 12, 16


class Block:
    """The vectors that one task trains: those of sources, then those of neighbours, if they have their own."""

    def __init__(self, rows: pa.Table, dim: int, negatives: int, rate: float, rng: np.random.Generator):
        self.role, self.ids = rows["role"].combine_chunks(), rows["id"].combine_chunks()
        self.first = pc.sum(pc.equal(self.role, 0)).as_py() or 0
        self.negatives, self.rate, self.rng = negatives, rate, rng
        if rows["v"].null_count:  # before the first turn
            self.v, self.past = np.zeros((len(rows), dim), np.float32), np.zeros(len(rows), np.float32)
            self.v[: self.first] = (rng.random((self.first, dim)) - 0.5) / dim
        else:
            self.v = np.frombuffer(b"".join(rows["v"].to_pylist()), np.float32).reshape(-1, dim).copy()
            self.past = rows["past"].to_numpy().copy()
        self.step = min(STEP, max(32, len(self.v) // 4))

    def learn(self, edges: pa.Table) -> None:
        """Each edge k times, in mixed order. Negatives are other ends of these edges, so they come by their in-degree."""
        split = self.first if self.first < len(self.v) else 0
        a = pc.index_in(edges["id"], value_set=self.ids[: self.first]).to_numpy()
        b = pc.index_in(edges["other"], value_set=self.ids[split:]).to_numpy() + split
        k = edges["k"].to_numpy()
        while len(k):
            pool = np.repeat(np.arange(len(k)), np.minimum(k, MIXED))
            order = self.rng.permutation(pool)
            for i in range(0, len(order), self.step):
                at = order[i : i + self.step]
                away = self.rng.integers(len(pool), size=(-(-len(at) // self.negatives), self.negatives))
                self._descend(a[at], b[at], b[pool[away]])
            more = k > MIXED
            a, b, k = a[more], b[more], k[more] - MIXED

    def gradients(self, a: np.ndarray, b: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers, and the way up of log s(a b) + sum of log s(-a n) for each of them; a row of negatives n goes with as many edges as it has, and one that is the edge's own end doesn't count."""
        groups, size = away.shape
        spare = groups * size - len(a)
        a, b = np.r_[a, a[:1].repeat(spare)], np.r_[b, b[:1].repeat(spare)]
        mine, near, far = self.v[a], self.v[b], self.v[away]
        dim = mine.shape[1]
        mine_of = mine.reshape(groups, size, dim)
        pull = 1 / (1 + np.exp(np.clip((mine * near).sum(axis=1), -30, 30)))
        push = -1 / (1 + np.exp(np.clip(-(mine_of @ far.transpose(0, 2, 1)), -30, 30)))
        push[away[:, None, :] == b.reshape(groups, size)[:, :, None]] = 0
        if spare:
            pull[-spare:] = 0
            push[-1, -spare:] = 0
        pull = pull[:, None]
        return np.concatenate([a, b, away.ravel()]), np.concatenate([pull * near + (push @ far).reshape(-1, dim), pull * mine, (push.transpose(0, 2, 1) @ mine_of).reshape(-1, dim)])

    def _descend(self, a: np.ndarray, b: np.ndarray, away: np.ndarray) -> None:
        """One step of row-wise AdaGrad, whose length has a bound however often a vertex comes in it."""
        rows, up = self.gradients(a, b, away)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        total, at = np.add.reduceat(up[order], starts, axis=0), rows[starts]
        self.past[at] += (total * total).mean(axis=1)
        self.v[at] += self.rate * total / np.sqrt(self.past[at] + 1e-12)[:, None]

    def rows(self, size: int = 10_000) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.v), size):
            v = self.v[i : i + size]
            ends = np.arange(len(v) + 1, dtype=np.int32) * (v.shape[1] * 4)
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(v.tobytes())])
            yield pa.RecordBatch.from_arrays([self.role[i : i + size], self.ids[i : i + size], packed, pa.array(self.past[i : i + size])], ["role", "id", "v", "past"])


def trained(dim: int, negatives: int, rate: float, seed: list[int]) -> Callable:
    """Rows of vectors, whose k is null, and then edges, to the rows of these vectors after a turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, edges, block = [], [], None

        def learn() -> Block:
            made = block or Block(pa.Table.from_batches(vectors), dim, negatives, rate, np.random.default_rng([*seed, TaskContext.get().partitionId()]))
            if edges:
                made.learn(pa.Table.from_batches(edges))
            edges.clear()
            return made

        for x in batches:
            n = x["k"].null_count
            if n:
                vectors.append(x.slice(0, n))
            if n < len(x):
                edges.append(x.slice(n))
            if sum(map(len, edges)) >= CHUNK:
                block = learn()
        if vectors:
            yield from learn().rows()

    return run


def unpacked(dim: int) -> Callable:
    """(id, v) to (id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = np.frombuffer(b"".join(x["v"].to_pylist()), np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([x["id"], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(v))], ["id", "embedding"])

    return run
