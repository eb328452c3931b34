import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def graph(spark):
    """Builds a graph from (src, dst[, etype[, weight]]) rows."""
    from graphlake.operators.graph import PropertyGraph

    def make(rows, vertices=None):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "x", float(r[3]) if len(r) > 3 else 1.0) for r in rows]
        e = spark.createDataFrame(full, "src_id bigint, dst_id bigint, etype string, weight double")
        v = spark.createDataFrame(vertices, "id bigint, kind int") if vertices is not None else None
        return PropertyGraph.from_edges(e, vertices=v)

    return make


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(v is None, v) for v in r])
