import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphlake.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


def counts(spark, sizes):
    data = [(1_000_000 * k + i, s, t) for k, (s, ts) in enumerate(sizes) for i, t in enumerate(ts)]
    return spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")


def test_tree_is_exact_and_repeatable():
    have = [100, 7, 0, 33]
    a, b = M.split_blocks(have, 5, 3), M.split_blocks(have, 5, 3)
    assert (a == b).all() and a.sum(axis=0).tolist() == have
    assert max(a.sum(axis=1)) - min(a.sum(axis=1)) <= 1
    assert M.split_blocks([0, 0], 3, 1).sum() == 0


def test_tree_draws_are_hypergeometric():
    first = np.array([M.split_blocks([60, 20], 2, s)[0, 1] for s in range(400)])
    n, k, t = 40, 20, 80
    var = n * (k / t) * (1 - k / t) * (t - n) / (t - 1)
    assert abs(first.mean() - 10) < 0.4 and 0.6 * var < first.var() < 1.5 * var


def test_shares_caps_and_names(spark):
    c = counts(spark, [("A b", [100] * 400), ("a  B ", [100] * 50), ("C", [50] * 40), (None, [10] * 5), ("other", [10] * 5), ("Z", [0, 0])])
    t = spark.createDataFrame([("A B", 0.5, 1), ("c", 0.25, 3), ("none", 0.25, 9)], TARGETS)
    sel = M.mix(c, t, shards=4)
    by = {r["source"]: r for r in M.mixture_shares(sel, t).collect()}
    assert by["c"]["most_repeats"] == 3 and by["c"]["n_tokens"] == 6000
    assert by["A B"]["actual_share"] == pytest.approx(2 / 3, abs=0.01) and by["none"]["n_tokens"] == 0
    assert sel.groupBy("doc_id", "pass").count().filter("count > 1").count() == 0
    assert rows(sel) == rows(M.mix(c, t, shards=4))
    assert {r["source"] for r in sel.select("source").distinct().collect()} == {"A B", "c"}


def test_blocks_are_disjoint_and_shards_even(spark, monkeypatch):
    monkeypatch.setattr(M, "MIN_BLOCK_TOKENS", 200)
    c = counts(spark, [("a", [10] * 2000), ("b", [10] * 1000)])
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 2)], TARGETS)
    sel = M.mix(c, t, total_tokens=25_000, shards=8)
    assert sel.groupBy("doc_id", "pass").count().filter("count > 1").count() == 0
    got = {r["source"]: r["t"] for r in sel.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert 14_980 <= got["a"] <= 15_000 and 9_980 <= got["b"] <= 10_000
    per = [r["t"] for r in sel.groupBy("shard").agg(F.sum("n_tokens").alias("t")).collect()]
    assert len(per) == 8 and max(per) < 2 * min(per)


def test_shuffled_shards_stay_together(spark):
    c = counts(spark, [("a", [10] * 100)])
    sel = M.shuffled_shards(M.mix(c, spark.createDataFrame([("a", 1.0, 1)], TARGETS), shards=3), 3)
    where = sel.withColumn("p", F.spark_partition_id()).select("shard", "p").distinct().collect()
    assert len({r["shard"] for r in where}) == len(where)


def test_more_than_the_caps_allow_falls_short(spark):
    c = counts(spark, [("a", [10] * 10), ("b", [10] * 10)])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS)
    by = {r["source"]: r["n_tokens"] for r in M.mixture_shares(M.mix(c, t, total_tokens=400), t).collect()}
    assert by == {"a": 100, "b": 200}


def test_empty(spark):
    t = spark.createDataFrame([("a", 0.5, 1), (None, 0.5, 1)], TARGETS)
    assert rows(M.mix(counts(spark, []), t)) == []
    assert rows(M.mix(counts(spark, [("a", [5])]), t.limit(0))) == []


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "Hello world, hello!", "s", 9), (2, None, None, 9), (3, "", "s", 9), (4, "<|endoftext|>", "s", 9)], "doc_id bigint, text string, source string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in M.token_counts(d, M.default_vocabulary(spark)).collect()}
    assert got[2] == got[3] == 0 and got[1] == 5 and got[4] > 1


def test_draws_of_a_segment_match_the_draws_one_by_one():
    q = M.Quota("a", 1.0, 5, 25)
    d = M._Draws(q, {b: 10 for b in (2, 3, 5, 7)}, 1, 0)
    one = [d.taken(k, 1)[0] for k in range(len(d))]
    assert len(d) == 23 and [r for _, _, _, r in one[20:]] == [None, None, 5]
    for at in range(len(d)):
        for n in range(1, len(d) - at + 1):
            got = sorted((b, first + k) for b, first, times, _ in d.taken(at, n) for k in range(times))
            assert got == sorted((b, first) for b, first, _, _ in one[at : at + n]), (at, n)


def test_many_repeats_are_a_number_and_not_rows():
    d = M._Draws(M.Quota("a", 1.0, 1_000_000, 0), {0: 5, 1: 5}, 1, 0)
    assert d.taken(1, 1_999_998) == d.taken(1, 1_999_998) and sum(t for _, _, t, _ in d.taken(1, 1_999_998)) == 1_999_998
    assert len(d.taken(1, 1_999_998)) == 2


def test_every_partition_holds_one_shard(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_TOKENS", 700)
    monkeypatch.setattr(M, "MIN_BLOCK_TOKENS", 50)
    c = counts(spark, [("a", [10] * 700), ("b", [10] * 300)])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS)
    sel = M.mix(c, t)
    n = sel.agg(F.max("shard")).first()[0] + 1
    assert n >= 15
    where = M.shuffled_shards(sel).withColumn("p", F.spark_partition_id()).select("shard", "p").distinct().collect()
    assert len(where) == n and all(r["shard"] == r["p"] for r in where)
