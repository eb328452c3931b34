"""Readers and writers of graph tables, model tables and batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph


def load_edges(spark: SparkSession, path: str, sep: str = " ") -> PropertyGraph:
    """A graph from delimited lines 'src dst' without header; lines that are not two numbers are dropped.

    The reverse of an edge is the same row read the other way, so no second
    copy is stored.
    """
    return PropertyGraph.from_edges(spark.read.csv(path, sep=sep, schema="src_id bigint, dst_id bigint", mode="DROPMALFORMED"))


def write_edges(graph: PropertyGraph, path: str, sep: str = " ") -> None:
    """The inverse of ``load_edges``."""
    graph.links().write.mode("overwrite").csv(path, sep=sep)


def init_vertices(graph: PropertyGraph) -> DataFrame:
    """(vid, in_degree, out_degree) of all ends of edges."""
    return graph.degrees()


def graph_from_json_tables(out_edges: DataFrame, vertices: DataFrame | None = None, weight_key: str | None = None) -> PropertyGraph:
    """A graph from tables (owner_vertex, other_vertex, properties, etype) and (id, properties) with JSON text.

    ``weight_key`` extracts a number as the column weight; broken JSON and
    text that is no number give null. JSON is parsed while scanning.
    """
    cols = [F.col("owner_vertex").alias("src_id"), F.col("other_vertex").alias("dst_id"), "properties", *(["etype"] if "etype" in out_edges.columns else [])]
    if weight_key:
        cols.append(json_property("properties", weight_key, "double").alias("weight"))
    return PropertyGraph.from_edges(out_edges.select(*cols), vertices=vertices)


def json_property(column: str, key: str, kind: str = "string"):
    """A property of JSON text cast to a type; null if it is missing, broken or of another kind."""
    return F.get_json_object(F.col(column), f"$['{key}']").try_cast(kind)


def write_by_type(graph: PropertyGraph, path: str, column: str = "etype") -> None:
    """Edges partitioned by type, so that a typed read opens only its own folder."""
    graph.edges.write.mode("overwrite").partitionBy(column).parquet(path)


def save_table(df: DataFrame, name: str) -> int:
    """Store a result under a table name; the number of its rows."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name).count()


def batches(df: DataFrame, columns: Sequence[str], size: int, order_by: Sequence[str] = ()) -> Iterator[pd.DataFrame]:
    """Rows in batches on the driver, a partition at a time; for small tables and tools outside Spark."""
    src = df.orderBy(*order_by) if order_by else df
    rows: list[Any] = []
    for r in src.select(*columns).toLocalIterator(prefetchPartitions=True):
        rows.append(tuple(r))
        if len(rows) == size:
            yield pd.DataFrame(rows, columns=list(columns))
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=list(columns))
