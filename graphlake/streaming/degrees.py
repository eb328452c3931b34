"""Degrees of a growing edge table, kept up to date by a stream.

Each micro-batch is folded to one row per vertex and written as a delta named
by its batch, so a batch that is delivered again replaces itself. Reading sums
the deltas; ``compact`` folds them into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlake.operators.graph import PropertyGraph

_SCHEMA = "vid bigint, in_degree bigint, out_degree bigint"


class DegreeStream:
    """Deltas of degrees under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, edges: DataFrame, batch: int) -> None:
        """Fold one batch of edges (src_id, dst_id) into a delta."""
        PropertyGraph.from_edges(edges).degrees().write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Follow a stream of edges until it is stopped; all that is there is read at once."""
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.add).start()

    def degrees(self) -> DataFrame:
        """(vid, in_degree, out_degree) of everything seen."""
        deltas = self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)
        return deltas.groupBy("vid").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))

    def compact(self, to: str) -> DegreeStream:
        """All deltas as one, in another folder."""
        self.degrees().write.mode("overwrite").parquet(f"{to.rstrip('/')}/batch=-1")
        return DegreeStream(self.spark, to)
