import random

from conftest import rows

from graphlake.llm.match_groups import match_groups


def brute(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((root(v), v) for v in parent)


def run(spark, *tables):
    return rows(match_groups([spark.createDataFrame(t, "a bigint, b bigint") for t in tables]))


def test_random_pairs_across_tables(spark):
    rng = random.Random(2)
    one = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)] + [(None, 3), (4, None)]
    two = [(rng.randrange(60), rng.randrange(60)) for _ in range(15)]
    assert run(spark, one, two + two) == brute(one + two)


def test_chains_stars_and_self_pairs(spark):
    rng = random.Random(3)
    ids = list(range(80))
    rng.shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    star = [(500, 500 + i) for i in range(1, 90)]
    pairs = chain + star + [(900, 900), (-5, -5), (-5, 900)] + [(1000, 1000)]
    assert run(spark, pairs) == brute(pairs)


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == []
    df = spark.createDataFrame([(2, 1, 7, 8, 9)], "src bigint, dst bigint, v bigint, u bigint, m bigint")
    assert rows(match_groups([df])) == [(1, 1), (1, 2)]


def low_bounds(monkeypatch):
    from graphlake.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "MOST_HOT", 40)


def test_hot_vertices_are_not_shuffled_by_their_id(spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphlake.llm import match_groups as M

    low_bounds(monkeypatch)
    star = [(0, k) for k in range(1, 2000)] + [(k, k + 1) for k in range(3000, 3040)]
    df = spark.createDataFrame(star + [(b, a) for a, b in star], "v bigint, u bigint")
    least = df.groupBy("v").agg(F.min("u").alias("mu"), F.count(F.lit(1)).alias("n"))
    joined = M._round(df, least, df.count())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert run(spark, star) == brute(star)


def test_random_forests_with_hot_vertices(spark, monkeypatch):
    low_bounds(monkeypatch)
    for seed in range(2):
        rng = random.Random(seed)
        n = 400
        ids = rng.sample(range(-1000, 5000), n)
        pairs = [(ids[rng.randrange(max(1, k - rng.choice((1, 3, k))), k) if k > 1 else 0], ids[k]) for k in range(1, n) if rng.random() < 0.93]
        pairs += [(ids[7], ids[k]) for k in range(0, n, 5)] + [(ids[3], ids[3])]
        assert run(spark, pairs) == brute(pairs), seed
