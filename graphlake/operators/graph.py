"""Property graphs: two DataFrames and the operators on them.

Vertices have a key ``id`` and any attributes, edges have ``src_id``,
``dst_id`` and any attributes; parallel edges and self-loops are allowed. Ids
may be LONG or STRING. Operators select the columns they need, so further
columns neither cost a read nor clash. Edges with a null end belong to no walk
and are dropped on construction.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    """A directed multigraph; ``vertices`` may be None and is then derived from the edges."""

    edges: DataFrame
    vertices: DataFrame | None = None

    @classmethod
    def from_edges(cls, edges: DataFrame, src: str = "src_id", dst: str = "dst_id", vertices: DataFrame | None = None) -> PropertyGraph:
        """A graph over any edge table; ``src`` and ``dst`` become src_id and dst_id."""
        e = edges
        for have, want in ((src, "src_id"), (dst, "dst_id")):
            if have != want:
                e = e.drop(want).withColumnRenamed(have, want)
        return cls(e.filter(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()), vertices)

    def of_type(self, value: Any, column: str = "etype") -> PropertyGraph:
        """Only edges whose ``column`` equals ``value``; the filter reaches the scan."""
        return PropertyGraph(self.edges.filter(F.col(column) == value), self.vertices)

    def where(self, predicate: str) -> PropertyGraph:
        """Only edges that satisfy a SQL predicate."""
        return PropertyGraph(self.edges.filter(F.expr(predicate)), self.vertices)

    def reversed(self) -> PropertyGraph:
        """Every edge turned round."""
        names = {"src_id": "dst_id", "dst_id": "src_id"}
        return PropertyGraph(self.edges.select(*(F.col(c).alias(names.get(c, c)) for c in self.edges.columns)), self.vertices)

    def links(self, *extra: str) -> DataFrame:
        """The edge columns an operator needs."""
        return self.edges.select("src_id", "dst_id", *extra)

    def undirected(self) -> DataFrame:
        """(src_id, dst_id) of every edge in both directions."""
        pair = lambda a, b: F.struct(F.col(a).alias("src_id"), F.col(b).alias("dst_id"))
        return self.edges.select(F.explode(F.array(pair("src_id", "dst_id"), pair("dst_id", "src_id"))).alias("x")).select("x.src_id", "x.dst_id")

    def simple_pairs(self) -> DataFrame:
        """(a, b) with a < b of every connected pair, once."""
        return self.edges.filter("src_id <> dst_id").select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).distinct()

    def vertex_ids(self) -> DataFrame:
        """(id) of all vertices: those of the vertex table, or the ends of edges."""
        if self.vertices is not None:
            return self.vertices.select("id").filter(F.col("id").isNotNull()).distinct()
        return self.edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()

    def degrees(self) -> DataFrame:
        """(vid, in_degree, out_degree) of the ends of edges, 0 where there are none.

        Both degrees come from one pass and one shuffle of partial counts.
        """
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src_id").alias("vid"), F.lit(1).alias("o")), F.struct(F.col("dst_id").alias("vid"), F.lit(0).alias("o")))).alias("x"))
        return ends.groupBy("x.vid").agg(F.sum(1 - F.col("x.o")).cast("bigint").alias("in_degree"), F.sum("x.o").cast("bigint").alias("out_degree"))
