from conftest import rows
from pyspark.sql import functions as F

from graphlake.operators.skew import KeyColumn, heavy_keys, key_stats


def stats(spark, data, schema="k bigint, n bigint"):
    df = spark.createDataFrame(data, schema)
    return key_stats([KeyColumn("t", "k", df, F.col("k"), F.col("n"))])


def test_counts_rows_and_neighbours_with_nulls_and_repeats(spark):
    got = rows(stats(spark, [(1, 2), (1, 2), (1, 3), (1, None), (None, 4), (2, None)]))
    assert got == [("t", "k", 1, 4, 2), ("t", "k", 2, 1, 0), ("t", "k", None, 1, 1)]


def test_heavy_keys_use_all_rows_and_drop_null(spark):
    data = [(None, 1)] * 50 + [(7, i) for i in range(49)] + [(8, 1)]
    assert [r["vid"] for r in heavy_keys(stats(spark, data), 0.02).collect()] == [7]
    assert {r["vid"] for r in heavy_keys(stats(spark, data), 0.01).collect()} == {7, 8}


def test_empty_table_and_clashing_columns(spark):
    assert rows(stats(spark, [])) == []
    df = spark.createDataFrame([(1, 2, 3, 4)], "code int, vid bigint, nbr bigint, n_rows bigint")
    got = key_stats([KeyColumn("t", "vid", df, F.col("vid"), F.col("nbr"))])
    assert rows(got) == [("t", "vid", 2, 1, 1)]


def test_plan_folds_before_the_shuffle(spark):
    plan = stats(spark, [(1, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan and "Window" not in plan
