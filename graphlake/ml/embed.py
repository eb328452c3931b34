"""Vertex embeddings: skip-grams over random walks, and vectors trained on edges."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.ml.sampling import random_walks, uniform
from graphlake.ml.vectors import trained, unpacked
from graphlake.operators.graph import PropertyGraph
from graphlake.storage import Rounds

#: Numbers of the vectors of a part, at most; below that, vectors are parted to this many tasks as soon as each has so many numbers.
PART_VALUES, TASKS, TASK_VALUES = 1 << 24, 6, 1 << 20


def _fit(sentences: DataFrame, dim: int, window: int, epochs: int, seed: int) -> DataFrame:
    w2v = Word2Vec(vectorSize=dim, windowSize=window, minCount=0, maxIter=epochs, seed=seed, inputCol="words", outputCol="v")
    return w2v.fit(sentences).getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("embedding"))


def deepwalk(graph: PropertyGraph, walk_len: int = 10, walks_per_vertex: int = 4, window: int = 5, dim: int = 32, weight: str | None = None, epochs: int = 1, seed: int = 7) -> DataFrame:
    """(id, embedding): ids as text; vertices that walk together lie together.

    Words are trained by hierarchical softmax, in place of sampled softmax.
    """
    walks = None
    for i in range(walks_per_vertex):
        part = random_walks(graph, walk_len, seed + i, weight).select(F.transform("walk", lambda x: x.cast("string")).alias("words"))
        walks = part if walks is None else walks.unionAll(part)
    return _fit(walks.filter(F.size("words") > 1), dim, window, epochs, seed)


def line(graph: PropertyGraph, proximity: int = 1, dim: int = 32, samples: int = 4, weight: str | None = None, epochs: int = 1, seed: int = 7, negatives: int = 5, rate: float = 0.1) -> DataFrame:
    """(id, embedding) of first proximity (the ends of an edge are alike) or second (vertices with like neighbours are alike).

    For second proximity a vertex has another vector in its role as a
    neighbour, which is dropped afterwards. Heavier edges are sampled more
    often. An edge is told from ``negatives`` that end elsewhere.

    Vectors are parted by the hash of their id. In a turn each task trains on
    the edges between two parts that no other task has, and after as many
    turns as parts each edge had its turn; nothing is held by the driver.
    """
    if proximity not in (1, 2):
        raise ValueError("proximity is 1 or 2")
    e = graph.edges.filter(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull())
    if weight:
        mean = e.agg(F.avg(weight)).first()[0] or 1.0
        share = F.col(weight) / F.lit(float(mean)) * samples
        e = e.filter(F.col(weight) > 0).withColumn("_k", F.floor(share) + (uniform("src_id", "dst_id", seed=seed) < share - F.floor(share)).cast("int"))
    else:
        e = e.withColumn("_k", F.lit(samples))
    kinds = dict(e.dtypes)
    kind = kinds["src_id"] if kinds["src_id"] == kinds["dst_id"] else "string"
    e = e.filter("_k > 0").select(F.col("src_id").cast(kind).alias("id"), F.col("dst_id").cast(kind).alias("other"), F.col("_k").cast("bigint").alias("k"))
    store = Rounds(graph.edges.sparkSession, "line")
    ends = e.select(F.lit(0).alias("role"), "id").distinct().unionAll(e.select(F.lit(proximity - 1).alias("role"), F.col("other").alias("id")).distinct())
    vectors, seen = store.write((ends.distinct() if proximity == 1 else ends).withColumns({"v": F.lit(None).cast("binary"), "past": F.lit(None).cast("float")}), n=F.count(F.lit(1)))
    values = seen["n"] * dim
    parts = max(1, -(-values // PART_VALUES), min(TASKS, values // TASK_VALUES))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    turns, _ = store.write(e.withColumn("turn", F.pmod(part("id") + part("other"), F.lit(parts))).sortWithinPartitions("turn"))
    for epoch in range(epochs):
        for turn in range(parts):
            met = F.pmod(turn - part("id"), F.lit(parts))
            home = F.least(part("id"), met) if proximity == 1 else F.when(F.col("role") == 0, part("id")).otherwise(met)
            edges = turns.filter(F.col("turn") == turn).select("id", "other", "k", F.lit(0).alias("role"), F.xxhash64("id", "other", F.lit(seed + epoch)).alias("place"))
            rows = vectors.unionByName(edges, allowMissingColumns=True).repartitionById(parts, home).sortWithinPartitions(F.col("k").isNotNull(), "place", "role", "id", "other", "k")
            new, _ = store.write(rows.select("role", "id", "other", "k", "v", "past").mapInArrow(trained(dim, negatives, rate, [seed, epoch, turn]), vectors.schema))
            store.drop(vectors)
            vectors = new
    store.drop(turns)
    return vectors.filter("role = 0").select(F.col("id").cast("string").alias("id"), "v").mapInArrow(unpacked(dim), "id string, embedding array<double>")
