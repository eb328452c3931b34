import numpy as np
import pyarrow as pa
import pytest

from graphlake.ml import embed
from graphlake.ml.vectors import Block


def _block(rng, n=12, dim=3):
    v = rng.normal(size=(n, dim)).astype(np.float32)
    rows = pa.table({"role": pa.array([0] * n, pa.int32()), "id": pa.array(range(n)), "v": pa.array([x.tobytes() for x in v]), "past": pa.array(np.zeros(n, np.float32))})
    return Block(rows, dim, 2, 0.1, rng)


def test_gradients_of_an_edge_match_differences():
    rng = np.random.default_rng(0)
    block = _block(rng)
    block.v = block.v.astype(np.float64)
    a, b, away = np.array([0, 1, 0]), np.array([3, 4, 5]), np.array([[4, 6], [7, 7]])

    def gain():
        s = lambda x: np.log(1 / (1 + np.exp(-x)))
        v, total = block.v, 0.0
        for i in range(3):
            total += s(v[a[i]] @ v[b[i]]) + sum(s(-v[a[i]] @ v[n]) for n in away[i // 2] if n != b[i])
        return total

    rows, up = block.gradients(a, b, away)
    whole = np.zeros_like(block.v)
    np.add.at(whole, rows, up)
    for i in np.ndindex(block.v.shape):
        keep, h = block.v[i], 1e-5
        block.v[i] = keep + h
        more = gain()
        block.v[i] = keep - h
        less = gain()
        block.v[i] = keep
        assert whole[i] == pytest.approx((more - less) / (2 * h), abs=1e-6)


def test_an_edge_is_learned_as_often_as_it_is_sampled():
    block, seen = _block(np.random.default_rng(1)), []
    block._descend = lambda a, b, away: seen.extend(zip(a.tolist(), b.tolist(), strict=True))
    block.learn(pa.table({"id": [0, 1, 2], "other": [3, 4, 5], "k": [1, 40, 1000]}))
    assert {e: seen.count(e) for e in set(seen)} == {(0, 3): 1, (1, 4): 40, (2, 5): 1000}


@pytest.mark.parametrize("proximity", [1, 2])
@pytest.mark.parametrize("parts", [1, 4, 5])
def test_line_over_parts_of_the_vectors(spark, graph, monkeypatch, proximity, parts):
    """Every edge has its turn whatever the parts, no vector or vocabulary goes through the driver, and vertices of one half lie together."""
    monkeypatch.setattr(embed.Word2Vec, "fit", lambda *_: pytest.fail("one task and the driver hold all vectors"))
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b) // 2 * 2 + int(a) % 2) for a, b in rng.integers(0, 200, (4000, 2))]
    n = len({a for a, _ in edges} | {b for _, b in edges if proximity == 1})
    both = n if proximity == 1 else n + len({b for _, b in edges})
    monkeypatch.setattr(embed, "PART_VALUES", -(-both * 8 // parts))
    tasks = []
    train = embed.trained
    monkeypatch.setattr(embed, "trained", lambda *how: tasks.append(how[-1]) or train(*how))
    got = {int(r["id"]): np.array(r["embedding"]) for r in embed.line(graph(edges), proximity, dim=8, samples=4, epochs=3).collect()}
    assert len(tasks) == 3 * parts and len(got) == n
    unit = {i: v / np.linalg.norm(v) for i, v in got.items()}
    alike = lambda same: np.mean([unit[i] @ unit[j] for i in unit for j in unit if i != j and (i % 2 == j % 2) == same])
    assert alike(True) > alike(False) + 0.2


def test_line_is_the_same_again_and_keeps_ids_as_they_are(spark):
    from graphlake.operators.graph import PropertyGraph

    edges = spark.createDataFrame([("~a", "b", 1.0), ("b", "~a", 3.0), ("b", "c", 0.0), ("d", None, 1.0)], "src_id string, dst_id string, w double")
    runs = [{r["id"]: r["embedding"] for r in embed.line(PropertyGraph(edges), 2, dim=4, weight="w").collect()} for _ in range(2)]
    assert runs[0] == runs[1] and set(runs[0]) == {"~a", "b"}
    assert set(r["id"] for r in embed.line(PropertyGraph(edges), 1, dim=4).collect()) == {"~a", "b", "c"}
