import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphlake.operators import community, dag, paths, rank, shortest, traversal, triangles
from graphlake.operators.components import weakly_connected_components
from graphlake.operators.graph import PropertyGraph
from graphlake.operators.lookup import lookup_edges, lookup_vertices
from graphlake.operators.metapath import Step, meta_path_search, parse_sample_path, parse_sample_paths

DIAMOND = [(1, 2), (1, 3), (2, 4), (3, 4)]
DAG = [(1, 2), (1, 3), (1, 4), (1, 5), (3, 5), (3, 6), (4, 6), (5, 7)]
BRIDGE = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)]


def test_degrees(graph):
    assert rows(graph([(1, 2), (1, 2), (2, 3)]).degrees()) == [(1, 0, 2), (2, 2, 1), (3, 1, 0)]


def test_bfs(graph):
    assert rows(traversal.bfs_from(graph(DIAMOND), 1)) == [(1, 2, 0), (1, 3, 0), (2, 4, 1), (3, 4, 1)]
    assert rows(traversal.bfs_from(graph([(1, 1), (1, 2), (1, 2)]), 1)) == [(1, 1, 0), (1, 2, 0)]
    assert len(rows(traversal.bfs_from(graph([(1, 2), (1, 2)]), 1, distinct=False))) == 2
    assert rows(traversal.bfs_from(graph(DIAMOND), 99)) == []


def test_neighbours(graph):
    g = graph([(1, 2), (3, 1), (3, 4), (4, 5)])
    assert rows(traversal.neighbours(g, 1, 2)) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(traversal.neighbours(g, 1, 2, edges=True)) == [(1, 2), (3, 1), (3, 4)]
    assert rows(traversal.neighbours(g, 1, 1, edges=True)) == [(1, 2), (3, 1)]


def test_walk_counts(graph):
    assert rows(traversal.out_walk_count(graph(DIAMOND), 2)) == [(1, 2), (2, 1), (3, 1)]
    assert rows(traversal.in_walk_count(graph(DIAMOND), 2)) == [(2, 1), (3, 1), (4, 2)]
    assert rows(traversal.walk_count(graph(DIAMOND), 2)) == [(1, 2), (2, 2), (3, 2), (4, 2)]
    assert rows(traversal.k_hop_distinct_count(graph(DIAMOND), 2)) == [(1, 3), (2, 1), (3, 1)]


def test_walks(graph):
    g = graph(DAG)
    got = {tuple(r["path"]) for r in paths.walks_from(g, [1], 16).collect()}
    assert got == {(1, 2), (1, 3, 5, 7), (1, 3, 6), (1, 4, 6), (1, 5, 7)}
    back = {tuple(r["path"]) for r in paths.walks_from(g.reversed(), [7], 16).collect()}
    assert back == {(7, 5, 1), (7, 5, 3, 1)}
    cut = {tuple(r["path"]) for r in paths.walks_from(g, [1], 2).collect()}
    assert cut == {(1, 2), (1, 3, 5), (1, 3, 6), (1, 4, 6), (1, 5, 7)}
    assert [r["path"] for r in paths.walks_from(graph([(1, 2)]), [2], 4).collect()] == [[2]]
    assert rows(paths.paths_from(graph([(1, 2)]), [2], 4)) == []


def test_path_rows_are_numbered_in_order(graph):
    got = rows(paths.paths_from(graph([(1, 2, "a", 5), (2, 3, "b", 6), (1, 4, "c", 7)]), [1], 4, attr="weight"))
    assert got == [(1, 0, 1, 2, 5.0), (1, 1, 2, 3, 6.0), (2, 0, 1, 4, 7.0)]
    assert len(rows(paths.backtrack(graph([(1, 2), (1, 2), (2, 3)]), [3], 4))) == 4


def test_walks_stop_at_the_limit(graph):
    assert {len(r["path"]) for r in paths.walks_from(graph([(1, 1), (1, 1)]), [1], 50, max_discovered=10).collect()} == {4}


def test_walks_have_no_bound_unless_asked_for(spark):
    n = 1_000_001
    e = spark.range(n).select(F.col("id").alias("src_id"), (F.col("id") % 10 - 10).alias("dst_id"))
    g = PropertyGraph.from_edges(e)
    sources = e.select(F.col("src_id").alias("id"))
    assert paths.path_edge_rows(paths.walks_from(g, sources, 4)).count() == n
    with pytest.warns(UserWarning, match="max_discovered"):
        assert paths.path_edge_rows(paths.walks_from(g, sources, 4, max_discovered=1_000_000)).count() == 0


def test_components(graph):
    g = graph([(1, 2), (2, 3), (10, 9), (7, 7)])
    assert rows(weakly_connected_components(g)) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 9), (10, 9)]
    chain = graph([(i, i + 1) for i in range(40)])
    assert {r["attr"] for r in weakly_connected_components(chain).collect()} == {0}
    r = graph([(1, 2), (2, 1), (2, 3)])
    assert rows(traversal.strongly_connected_component(r, 1)) == [(1,), (2,)]
    assert rows(traversal.weakly_connected_component(r, 3)) == [(1,), (2,), (3,)]


def test_cycle_cores(graph):
    g = graph([*BRIDGE, (0, 1), (5, 6)])
    assert rows(dag.cycle_detect_in(g)) == [(i,) for i in (1, 2, 3, 4, 5, 6)]
    assert rows(dag.cycle_detect_out(g)) == [(i,) for i in (0, 1, 2, 3, 4, 5)]
    assert rows(dag.cycle_core(g)) == [(i,) for i in (1, 2, 3, 4, 5)]
    assert rows(dag.cycle_core(graph(DAG))) == []


def test_cycles(graph):
    got = {tuple(r["path"]) for r in dag.cycles(graph([*BRIDGE, (3, 3), (1, 6), (6, 2)])).collect()}
    assert got == {(1, 2, 1), (4, 5, 4), (3, 3), (1, 6, 2, 1)}
    assert {tuple(r["path"]) for r in dag.cycles(graph(BRIDGE), max_length=1).collect()} == set()
    assert [tuple(r["path"]) for r in dag.cycles(graph(BRIDGE), num_limit=1).collect()] == [(1, 2, 1)]
    typed = dag.cycles(graph([(1, 2, "a"), (2, 1, "b"), (2, 1, "c")]), edge_type="etype").collect()
    assert {tuple(r["edges_type"]) for r in typed} == {("a", "b"), ("a", "c")}


def test_cycles_from(graph, spark):
    g = graph([(1, 2), (2, 3), (3, 1), (2, 1), (3, 4), (4, 1)])
    assert {tuple(r["path"]) for r in paths.cycles_from(g, 1).collect()} == {(1, 2, 1), (1, 2, 3, 1), (1, 2, 3, 4, 1)}
    only = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    assert {tuple(r["path"]) for r in paths.cycles_from(g, 1, only).collect()} == {(1, 2, 1), (1, 2, 3, 1)}


def test_topo(graph):
    assert rows(dag.topo_sorting(graph(DIAMOND))) == [(1, 1), (2, 2), (3, 2), (4, 3)]
    with pytest.raises(ValueError):
        dag.topo_sorting(graph(BRIDGE))


def test_longest(graph):
    got = rows(paths.longest_paths(graph(DAG)))
    assert got == [("1-->3-->5-->7", 3)]
    w = graph([(1, 2, "x", 5), (2, 3, "x", -9), (1, 3, "x", 1)])
    assert rows(paths.longest_weighted_path(w, "weight")) == [("1-->2", 5.0)]
    with pytest.raises(ValueError):
        paths.longest_paths(graph([(0, 1), (1, 2), (2, 1)]), max_length=20)


def test_shortest(graph):
    assert {tuple(r["path"]) for r in shortest.shortest_path(graph(DIAMOND), 1, 4, 5).collect()} == {(1, 2, 4), (1, 3, 4)}
    assert rows(shortest.shortest_path(graph([(1, 2), (3, 4)]), 1, 4, 5)) == []
    assert rows(shortest.shortest_path(graph(DIAMOND), 1, 4, 1)) == []
    assert rows(shortest.shortest_path(graph(DIAMOND), 1, 1, 4)) == [([1],)]
    typed = shortest.shortest_path(graph([(1, 2, "a"), (1, 2, "b"), (2, 3, "c")]), 1, 3, 5, edge_type="etype").collect()
    assert {tuple(r["edges_type"]) for r in typed} == {("a", "c"), ("b", "c")}
    chain = graph([(i, i + 1) for i in range(9)] + [(0, 20), (20, 9)])
    assert [r["path"] for r in shortest.shortest_path(chain, 0, 9, 20).collect()] == [[0, 20, 9]]


def test_shortest_weighted(graph):
    g = graph([(1, 2, "x", 1), (2, 4, "x", 5), (1, 3, "x", 2), (3, 4, "x", 2), (1, 4, "x", 9)])
    assert [(r["path"], r["weights"], r["total"]) for r in shortest.shortest_weighted_path(g, 1, 4, 5, "weight").collect()] == [([1, 3, 4], [2.0, 2.0], 4.0)]
    assert [(r["path"], r["total"]) for r in shortest.shortest_weighted_path(g, 1, 4, 1, "weight").collect()] == [([1, 4], 9.0)]
    assert rows(shortest.shortest_weighted_path(g, 4, 1, 5, "weight")) == []


def test_triangles(graph):
    g = graph([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (2, 1), (1, 1)])
    want = [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1)]
    assert rows(triangles.triangle_count(g)) == want
    assert rows(triangles.triangle_count_by_intersection(g)) == want


def test_pagerank(graph):
    got = dict(rows(rank.pagerank(graph([(1, 2), (2, 3), (3, 2)]), 0.15, None, 1)))
    assert got[1] == pytest.approx(1 / 3) and got[2] == pytest.approx(0.85 * 2 / 3 + 0.05) and got[3] == pytest.approx(0.85 / 3 + 0.05)
    done = dict(rows(rank.pagerank(graph([(1, 2), (2, 1)]), 0.15, 1e-9, 100)))
    assert done[1] == pytest.approx(0.5)
    assert rows(rank.pagerank(graph([]))) == []


def test_meta_path(graph):
    g = graph([(1, 2, "a"), (2, 3, "b"), (1, 4, "a")], vertices=[(1, 1), (2, 2), (3, 1), (4, 1), (2, 2)])
    assert rows(meta_path_search(g, ["vertices.kind = 1", "edges.etype = 'a'", "kind = 2", "true", "g_v.kind = 1"], [1, 1])) == [([1, 2, 3],)]
    assert rows(meta_path_search(g, ["kind = 2", "true", "true"], [-1])) == [([2, 1],)]
    with pytest.raises(ValueError):
        meta_path_search(g, ["true", "true"], [1])


def test_sample_path_grammar():
    assert parse_sample_path("(1) -[2]-> (3)<-[4]-(5)") == (1, [Step(2, True, 3), Step(4, False, 5)])
    for bad in ("", "(1)-[2]->", "(1)(2)(3)", "(1)-[2]->(3)x"):
        with pytest.raises(ValueError):
            parse_sample_path(bad)
    with pytest.raises(ValueError):
        parse_sample_paths(["(1)-[1]->(1)", "(2)-[1]->(1)"])


def test_lookup(graph, spark):
    v = spark.createDataFrame([(1, None, "a"), (2, 5, "b")], "vid bigint, n int, s string")
    assert rows(lookup_vertices(v, [1, 3], ["n", "s"])) == [(1, '{"n":null,"s":"a"}')]
    assert rows(lookup_edges(graph([(1, 2, "t", 3)]).edges, [1, 9], [2, 9], ["etype"])) == [(1, 2, '{"etype":"t"}')]


def ring_of_cliques():
    e = []
    for c in range(4):
        base = 10 * c
        e += [(base + i, base + j) for i in range(5) for j in range(i + 1, 5)]
        e.append((base, (base + 10) % 40))
    return e


def test_louvain_finds_cliques(graph, spark):
    got = community.louvain(graph(ring_of_cliques()), max_iter=3, max_iter_stage1=12)
    truth = spark.createDataFrame([(10 * c + i, c) for c in range(4) for i in range(5)], "vid bigint, cid bigint")
    assert community.nmi(got, truth).first()[0] > 0.8
    q = community.modularity(community.canonical_edges(graph(ring_of_cliques())), got).first()[0]
    assert q > 0.5


def test_partition_scores(spark):
    a = spark.createDataFrame([(i, i // 5) for i in range(20)], "vid bigint, cid bigint")
    assert community.nmi(a, a).first()[0] == pytest.approx(1) and community.ari(a, a).first()[0] == pytest.approx(1)
    one = a.select("vid", F.lit(0).alias("cid"))
    assert community.ari(a, one).first()[0] == pytest.approx(0)


def test_peel_writes_only_what_a_wave_meets(spark, graph, monkeypatch):
    from graphlake.operators import traversal

    written = []
    write = dag.Rounds.write

    def watched(self, df, **metrics):
        out, seen = write(self, df, **metrics)
        written.append(out.count())
        return out, seen

    monkeypatch.setattr(dag, "FOLD_EVERY", 4)
    monkeypatch.setattr(traversal, "FOLD_EVERY", 3)
    monkeypatch.setattr(dag.Rounds, "write", watched)
    n = 40
    g = graph([(i, i + 1) for i in range(n)] + [(0, n), (3, 20), (3, 20), (100, 101)])
    assert rows(dag.topo_sorting(g)) == sorted([(i, i + 1) for i in range(n + 1)] + [(100, 1), (101, 2)])
    assert sum(written) < 12 * n


def test_components_with_hot_vertices(spark, graph, monkeypatch):
    from graphlake.operators import components, skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(components, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "MOST_HOT", 20)
    g = graph([(7, k) for k in range(8, 300)] + [(k, k + 1) for k in range(400, 420)] + [(1, 250), (500, 500)])
    got = dict(rows(components.weakly_connected_components(g)))
    assert {v for k, v in got.items() if k < 400} == {1} and {v for k, v in got.items() if 400 <= k < 500} == {400} and got[500] == 500
