import random

from conftest import rows
from pyspark.sql import functions as F

from graphlake.operators import hierarchy as H
from graphlake.plans.data_queries import QUERIES


def build(spark, links, extra=False):
    df = spark.createDataFrame([(p, c, 1, 2) for p, c in links], "p bigint, v bigint, size int, up int")
    return H.hierarchy(df, F.col("p"), F.col("v"))


def brute(links):
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for v in {x for p, c in links if p is not None and c is not None for x in (p, c)}:
        path, x = [v], v
        while x in parent and len(path) <= len(parent) + 1:
            x = parent[x]
            path.append(x)
        ok = x not in parent
        out[v] = (x, len(path) - 1, "/".join(map(str, reversed(path)))) if ok else (-1, -1, "")
    return out


def test_random_forests_with_cycles_match_brute_force(spark):
    rng = random.Random(4)
    links = [(rng.randrange(i), i) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (200, 200), (200, 201)]
    links += [links[3], (None, 5), (7, None)]
    got = {r["vid"]: (r["root_vid"], r["depth"], r["path"]) for r in build(spark, links).collect()}
    assert got == brute(links)


def test_ranges_nest(spark, monkeypatch):
    monkeypatch.setattr(H, "SIBLINGS_PER_BUCKET", 3)
    links = [(0, i) for i in range(1, 12)] + [(1, 20), (1, 21), (20, 22), (5, 30)] + [(i, i + 1) for i in range(30, 70)]
    t = {r["vid"]: r for r in build(spark, links).collect()}
    assert sorted(r["lft"] for r in t.values()) == list(range(len(t)))
    for a in t.values():
        for b in t.values():
            below = f"/{a['vid']}/" in f"/{b['path']}/" and a["vid"] != b["vid"]
            assert below == (a["lft"] < b["lft"] <= a["rgt"])


def test_descendants_by_ranges(spark):
    tree = build(spark, [(1, 2), (2, 3), (1, 4), (9, 9)])
    of = spark.createDataFrame([(1,), (2,), (9,)], "vid bigint")
    assert rows(H.descendants(tree, of)) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]


def test_descendants_of_all_vertices(spark, tmp_path):
    rng = random.Random(5)
    links = [(rng.randrange(i), i) for i in range(1, 60)] + [(-3, -2), (-2, -1), (100, 101), (101, 100), (101, 102), (200, 200)]
    paths = [list(map(int, path.split("/"))) for _, _, path in brute(links).values() if path]
    pairs = sorted((a, p[-1], len(p) - 1 - i) for p in paths for i, a in enumerate(p[:-1]))
    assert rows(H.descendants(build(spark, links))) == pairs
    plan = H.descendants(build(spark, links))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    spark.createDataFrame([(p, c, 3) for p, c in links] + [(1, 300, 1)], "src_id bigint, dst_id bigint, edge_type int").write.parquet(f"{tmp_path}/edges.parquet")
    assert rows(QUERIES["p4_all_descendants"](spark, str(tmp_path))) == pairs


def test_deep_chain_and_empty(spark):
    n = 300
    got = {r["vid"]: r["depth"] for r in build(spark, [(i, i + 1) for i in range(n)]).collect()}
    assert got == {i: i for i in range(n + 1)}
    assert rows(build(spark, [])) == []
    assert rows(build(spark, [(None, 1), (1, None)])) == []


def test_siblings_are_in_the_order_of_their_ids_however_many(spark, monkeypatch):
    links = [(0, i) for i in range(1, 40)] + [(7, 100 + i) for i in range(30)] + [(-5, -6)]
    whole = {r["vid"]: (r["lft"], r["rgt"]) for r in build(spark, links).collect()}
    monkeypatch.setattr(H, "SIBLINGS_PER_BUCKET", 4)
    assert {r["vid"]: (r["lft"], r["rgt"]) for r in build(spark, links).collect()} == whole
    assert [v for v, _ in sorted(((v, x) for v, x in whole.items() if 1 <= v < 40), key=lambda t: t[1])] == list(range(1, 40))


def test_other_parents_are_reported(spark):
    links = [(1, 2), (3, 2), (3, 2), (5, 2), (2, 4), (9, 9), (8, 9), (None, 2)]
    df = spark.createDataFrame(links, "p bigint, v bigint")
    tree = H.hierarchy(df, F.col("p"), F.col("v"))
    assert rows(H.other_parents(df, F.col("p"), F.col("v"), tree)) == [(2, 3), (2, 5), (9, 9)]
    assert {r["vid"] for r in tree.filter("several").collect()} == {2, 9}


def test_range_blocks_find_every_descendant_once(spark):
    rng = random.Random(8)
    links = [(rng.randrange(max(0, i - 7), i), i) for i in range(1, 150)] + [(1000 + i, 1001 + i) for i in range(70)] + [(-3, -2), (300, 301), (301, 300)]
    tree = build(spark, links)
    heads = [v for v in range(0, 150, 2)] + [1000, 1001, 1033, 1070, -3, 300, 77777]
    got = rows(H.descendants(tree, spark.createDataFrame([(v,) for v in heads + heads], "vid bigint")))
    assert got == [r for r in rows(H.descendants(tree)) if r[0] in heads] and len(got) > 1000
    assert rows(H.descendants(tree, spark.createDataFrame([], "vid bigint"))) == []
