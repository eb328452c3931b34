from datetime import datetime as T

from conftest import rows
from pyspark.sql import functions as F

from graphlake.operators.orphans import Hierarchy, orphan_cascade, orphan_report

EDGES = "eid bigint, src_id bigint, dst_id bigint, edge_type int, created_at timestamp, row_key string, ref int"
VERTS = "vid bigint, created_at timestamp, deleted_at timestamp, at int"
JAN, FEB, MAR, APR = (T(2024, m, 1) for m in (1, 2, 3, 4))


def cascade(spark, edges, verts, tree=True):
    e = spark.createDataFrame([(*x, "clash", 0) for x in edges], EDGES)
    v = spark.createDataFrame([(*x, 0) for x in verts], VERTS)
    h = Hierarchy(F.col("dst_id"), F.col("src_id"), "src_id", F.col("edge_type") == 3) if tree else None
    return orphan_cascade(e, F.col("eid"), ["src_id", "dst_id"], F.col("created_at"), v, F.col("vid"), F.col("created_at"), F.col("deleted_at"), h)


def found(df):
    return sorted((r["row_key"], r["endpoint"], r["kind"]) for r in df.collect())


def test_lifetimes(spark):
    verts = [(1, JAN, None), (2, JAN, MAR), (2, APR, None), (3, APR, None), (3, APR, None)]
    edges = [(10, 1, 2, 1, FEB), (11, 1, 2, 1, MAR), (12, 1, 2, None, APR), (13, 3, 1, 1, MAR), (14, 9, 1, 1, MAR), (15, None, 1, 1, MAR), (16, 1, None, 1, MAR), (14, 9, 1, 1, MAR)]
    assert found(cascade(spark, edges, verts)) == [(11, "dst_id", "direct"), (13, "src_id", "direct"), (14, "src_id", "direct")]


def test_cascade_reaches_all_levels_once(spark):
    n = 21
    verts = [(i, JAN, None) for i in range(1, n + 1)]
    edges = [(0, 99, 1, 3, FEB)] + [(i, i, i + 1, 3, FEB) for i in range(1, n)] + [(100, 5, 6, 1, FEB)]
    got = found(cascade(spark, edges, verts))
    assert got == sorted([(0, "src_id", "direct")] + [(i, "src_id", "inherited") for i in range(1, n)])


def test_cascade_ends_on_cycles_and_self_links(spark):
    verts = [(i, JAN, None) for i in (1, 2, 3, 4)]
    edges = [(1, 1, 2, 3, FEB), (2, 2, 1, 3, FEB), (3, 4, 4, 3, FEB), (4, 9, 3, 3, FEB), (5, 3, 3, 3, FEB)]
    assert found(cascade(spark, edges, verts)) == [(4, "src_id", "direct"), (5, "src_id", "inherited")]


def test_report_and_empty_tables(spark):
    got = orphan_report(cascade(spark, [(1, 9, 9, 1, FEB)], []), "edges")
    assert rows(got) == [("edges", "dst_id", "2024-02", "direct", 1), ("edges", "src_id", "2024-02", "direct", 1)]
    assert found(cascade(spark, [], [])) == []
    assert found(cascade(spark, [], [], tree=False)) == []


def test_null_moment_is_covered_by_nothing(spark):
    assert found(cascade(spark, [(1, 1, 1, 1, None)], [(1, JAN, None)])) == [(1, "dst_id", "direct"), (1, "src_id", "direct")]


def test_cascade_with_several_parents_keeps_its_links(spark, monkeypatch):
    """Layers of records with three parents each, chains below them, and a cycle."""
    import random

    from graphlake.operators import orphans as O

    written = []
    write = O.Rounds.write

    def watched(self, df, **metrics):
        out, seen = write(self, df, **metrics)
        if set(df.columns) == {"key", "ptr"}:
            written.append(out.count())
        return out, seen

    monkeypatch.setattr(O.Rounds, "write", watched)
    r = random.Random(6)
    links = {(10 * k + r.randrange(10), 10 * (k + 1) + j) for k in range(1, 7) for j in range(10) for _ in range(3)}
    links |= {(75, 1000)} | {(k, k + 1) for k in range(1000, 1030)} | {(2000, 2001), (2001, 2000), (5, 14), (5, 2000)}
    alive = {v for x in links for v in x} - {5}
    edges = [(k, a, b, 3, FEB) for k, (a, b) in enumerate(sorted(links))]
    got = found(cascade(spark, edges, [(v, JAN, None) for v in sorted(alive)]))
    bad = {b for a, b in links if a == 5}
    while more := {b for a, b in links if a in bad} - bad:
        bad |= more
    want = [(k, "src_id", "direct" if a == 5 else "inherited") for k, a, b, _, _ in edges if a == 5 or a in bad]
    assert got == sorted(want) and len(bad) > 60
    assert written and max(written) <= len(links)
