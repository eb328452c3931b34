"""Attributes of given vertices and edges as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("attrs")


def _ids(spark, rows: list[tuple], names: list[str], like: DataFrame) -> DataFrame:
    kinds = dict(like.dtypes)
    schema = ", ".join(f"{n} {'string' if kinds[n] == 'string' else 'bigint'}" for n in names)
    return spark.createDataFrame(rows, schema)


def lookup_vertices(vertices: DataFrame, vids: Sequence | DataFrame, attributes: Sequence[str], vid: str = "vid") -> DataFrame:
    """(vid, attrs): JSON of the attributes of the listed vertices that exist, null values included.

    A list is as small as the caller's memory and goes to the scan as a
    broadcast; a DataFrame with the column ``vid`` is joined as it comes.
    """
    table = vertices.select(F.col(vid).alias("vid"), *(a for a in attributes if a != "vid"))
    if isinstance(vids, DataFrame):
        return table.join(vids.select("vid"), "vid").select("vid", _json(attributes))
    wanted = F.broadcast(_ids(vertices.sparkSession, [(v,) for v in vids], ["vid"], table))
    return table.join(wanted, "vid").select("vid", _json(attributes))


def lookup_edges(edges: DataFrame, src_ids: Sequence | DataFrame, dst_ids: Sequence | None, attributes: Sequence[str]) -> DataFrame:
    """(src_id, dst_id, attrs): JSON of the attributes of the edges between paired ids.

    Either two lists of one length, or a DataFrame with src_id and dst_id.
    """
    table = edges.select("src_id", "dst_id", *(a for a in attributes if a not in ("src_id", "dst_id")))
    if isinstance(src_ids, DataFrame):
        wanted = src_ids.select("src_id", "dst_id")
    else:
        wanted = F.broadcast(_ids(edges.sparkSession, list(zip(src_ids, dst_ids, strict=True)), ["src_id", "dst_id"], table))
    return table.join(wanted, ["src_id", "dst_id"]).select("src_id", "dst_id", _json(attributes))
