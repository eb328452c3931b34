"""Paths by a pattern of vertex and edge predicates, and the typed path grammar."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators.graph import PropertyGraph

_QUALIFIER = re.compile(r"\b(?:vertices|edges|edges_mirror|g_v|g_oe|g_ie|vertex_all|edge_all)\.")


def meta_path_search(graph: PropertyGraph, pattern: Sequence[str], orientation: Sequence[int]) -> DataFrame:
    """(path): vertex arrays that match a pattern of predicates.

    Odd places of ``pattern`` are predicates on vertex columns, even ones on
    edge columns; ``orientation`` has 1 for an edge walked forwards and -1 for
    one walked backwards, for each even place. Ids stand in walking order.
    Qualifiers of table names in front of a column are ignored; "true" matches
    all. The pattern has a fixed length, so this is one lazy plan, and each
    predicate reaches its scan. A repeated vertex row counts once.
    """
    if len(pattern) % 2 == 0 or len(orientation) != len(pattern) // 2:
        raise ValueError("a pattern has n vertex predicates, n - 1 edge predicates and n - 1 orientations")
    if graph.vertices is None:
        raise ValueError("vertex predicates need a vertex table")
    clean = [_QUALIFIER.sub("", p) for p in pattern]
    vertex = lambda p: graph.vertices.filter(F.expr(p)).select("id").filter(F.col("id").isNotNull()).distinct()
    paths = vertex(clean[0]).select(F.array("id").alias("path"), F.col("id").alias("tail"))
    for i, way in enumerate(orientation):
        a, b = ("src_id", "dst_id") if way == 1 else ("dst_id", "src_id")
        edges = graph.edges.filter(F.expr(clean[2 * i + 1])).select(F.col(a).alias("tail"), F.col(b).alias("next"))
        ends = vertex(clean[2 * i + 2]).select(F.col("id").alias("next"))
        paths = paths.join(edges.join(ends, "next", "left_semi"), "tail").select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("tail"))
    return paths.select("path")


@dataclass(frozen=True)
class Step:
    """One typed edge of a sample path and the vertex type it leads to."""

    edge_type: int
    forward: bool
    vertex_type: int


_NODE, _OUT, _IN = r"\((\d+)\)", r"-\[(\d+)\]->", r"<-\[(\d+)\]-"
_TOKEN = re.compile(rf"{_NODE}|{_OUT}|{_IN}")


def parse_sample_path(text: str) -> tuple[int, list[Step]]:
    """The start type and steps of a path such as ``(2)-[5]->(3)<-[5]-(2)``."""
    squeezed = re.sub(r"\s+", "", text)
    tokens = list(_TOKEN.finditer(squeezed))
    if not tokens or "".join(t.group(0) for t in tokens) != squeezed or len(tokens) % 2 == 0:
        raise ValueError(f"not a sample path: {text!r}")
    nodes, links = tokens[::2], tokens[1::2]
    if any(t.group(1) is None for t in nodes) or any(t.group(1) is not None for t in links):
        raise ValueError(f"vertices and edges must alternate: {text!r}")
    steps = [Step(int(e.group(2) or e.group(3)), e.group(2) is not None, int(n.group(1))) for e, n in zip(links, nodes[1:], strict=True)]
    return int(nodes[0].group(1)), steps


def parse_sample_paths(texts: Sequence[str]) -> list[tuple[int, list[Step]]]:
    """Several paths, which must start at one type and have one length."""
    paths = [parse_sample_path(t) for t in texts]
    if len({(s, len(p)) for s, p in paths}) > 1:
        raise ValueError("sample paths must share their start type and their length")
    return paths
