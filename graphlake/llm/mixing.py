"""Mixing sources to target weights (problem 7).

Token counts decide how much of each source is drawn: whole passes over its
pages and a part of one more. The pages of a source are spread over blocks by
a hash; a pass draws its blocks in a random order. Which shard gets how many
blocks of each source comes from a splitting tree: the blocks of a range of
shards are divided between its two halves by a multivariate hypergeometric
draw, down to single shards, so the quotas are exact at every level and any
branch can be drawn alone. Each shard then takes the next disjoint blocks of
each source and is shuffled within itself.

The driver only sees totals of sources and of blocks. Blocks are as large as
it takes to draw about ``MAX_BLOCKS`` of them with all repeats, and a block
that a shard takes in several passes is one row with a number. Shards are as
many as the drawn tokens need.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.storage import Rounds

#: Words, numbers, marks and blanks as the byte-level vocabularies split them.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks drawn from all sources together, about; and the tokens a block has at least.
MAX_BLOCKS = 40_000
MIN_BLOCK_TOKENS = 4_096
#: Tokens of a shard, about, and the blocks that it has at least on average.
SHARD_TOKENS = 1_000_000
BLOCKS_PER_SHARD = 20
#: Sources that a mixture may name.
MAX_SOURCES = 10_000


def token_counts(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens) by the byte-level vocabulary in the file ``vocabulary``; 0 for a null text.

    The file holds one base64 token and its rank a line. It is read once by
    the driver and travels with the tasks.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        enc = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    pages = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(source).cast("string").alias("s"), F.col(text).cast("string").alias("t"))
    return pages.mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def source_key(name: Column) -> Column:
    """A source name whatever its case and blanks; null for null or blank."""
    folded = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    return F.when(folded != "", folded)


@dataclass(frozen=True)
class Quota:
    """What is drawn of a source: whole passes, and tokens of one more."""

    source: str
    share: float
    passes: int
    rest: int


def quotas(totals: dict[str, int], targets: Sequence[tuple[str, float, int]], total_tokens: int | None = None) -> list[Quota]:
    """Passes and remaining tokens of each source.

    Sources without tokens cannot be drawn; the shares of the others keep
    their proportions. Without ``total_tokens`` the mixture is as large as the
    caps on repeats allow. With more than that, capped sources fall short.
    """
    live = [(s, w, r) for s, w, r in targets if totals.get(s, 0) > 0 and w > 0 and r > 0]
    weight = sum(w for _, w, _ in live)
    most = min((totals[s] * r / (w / weight) for s, w, r in live), default=0)
    size = most if total_tokens is None else total_tokens
    out = []
    for s, w, r in live:
        n = min(int(size * w / weight), totals[s] * r)
        out.append(Quota(s, w / weight, n // totals[s], n % totals[s]))
    return out


def split_blocks(counts: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows), by the splitting tree."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    stack = [(0, shards, np.asarray(counts, dtype=np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        # a node draws from its own seed, so that it can be drawn again alone
        rng = np.random.default_rng([seed, lo, hi])
        total = int(have.sum())
        left = rng.multivariate_hypergeometric(have, total * (mid - lo) // (hi - lo), method="marginals") if total else have
        stack.append((lo, mid, left))
        stack.append((mid, hi, have - left))
    return out


def mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, shards: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, pass, n_tokens, shard, order_key): one row per drawn page and pass, passes from 1.

    ``counts`` comes from ``token_counts``, ``targets`` has source,
    target_share and max_repeats. Names match whatever their case and blanks.
    Pages of a null or unnamed source, and pages without tokens, are not
    drawn. A page is drawn at most max_repeats times. A source misses its
    quota by less than its largest page in the last pass. A doc_id that comes
    twice counts as two pages. Without ``shards`` there is one for about each
    ``SHARD_TOKENS`` drawn tokens. Empty tables give no rows. The same seed
    gives the same mixture.
    """
    spark = counts.sparkSession
    store = Rounds(spark, "mixing")
    rows = targets.select(source_key(F.col("source")).alias("s"), F.col("source").alias("name"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("bigint").alias("r")).filter("s is not null and w is not null and r is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    wanted = sorted((r["s"], r["w"], r["r"]) for r in rows)
    named = spark.createDataFrame([(s,) for s, _, _ in wanted] or [("",)], "s string")
    pages, _ = store.write(counts.select("doc_id", source_key(F.col("source")).alias("s"), "n_tokens").join(F.broadcast(named), "s", "left_semi").filter("n_tokens > 0"))
    totals = {r["s"]: r["t"] for r in pages.groupBy("s").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = quotas(totals, wanted, total_tokens)
    names = {r["s"]: r["name"] for r in rows}
    drawn = sum(q.passes * totals[q.source] + q.rest for q in plan)
    if shards is None:
        shards = max(1, min(-(-drawn // SHARD_TOKENS), MAX_BLOCKS // (BLOCKS_PER_SHARD * max(1, len(plan) // BLOCKS_PER_SHARD))))
    size = max(MIN_BLOCK_TOKENS, -(-drawn // MAX_BLOCKS))
    n_blocks = {q.source: -(-totals[q.source] // size) for q in plan}
    sizes = spark.createDataFrame([(q.source, n_blocks[q.source]) for q in plan] or [("", 1)], "s string, nb bigint")
    spread = pages.join(F.broadcast(sizes), "s").withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("nb")).cast("int")).drop("nb")
    blocks: dict[str, dict[int, int]] = {}
    for r in spread.groupBy("s", "b").agg(F.sum("n_tokens").alias("t")).collect():  # about MAX_BLOCKS rows
        blocks.setdefault(r["s"], {})[r["b"]] = r["t"]
    draws = [_Draws(q, blocks.get(q.source, {}), seed, i) for i, q in enumerate(plan)]
    share = split_blocks([len(d) for d in draws], shards, seed)
    table = [(q.source, b, names[q.source], first, times, shard, rest) for i, q in enumerate(plan) for shard, at, n in _segments(share[:, i]) for b, first, times, rest in draws[i].taken(at, n)]
    schema = "s string, b int, source string, first int, times int, shard int, rest bigint"
    taken = spread.join(F.broadcast(spark.createDataFrame(table, schema)), ["s", "b"])
    each = taken.withColumn("pass", F.explode(F.sequence("first", F.col("first") + F.col("times") - 1))).drop("first", "times")
    return _cut(each, seed).select("doc_id", "source", "pass", "n_tokens", "shard", F.xxhash64("doc_id", "pass", F.lit(seed + 1)).alias("order_key"))


def _segments(counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first draw, number of draws) of the shards that draw anything."""
    ends = np.cumsum(counts)
    for shard in np.flatnonzero(counts):
        yield int(shard), int(ends[shard] - counts[shard]), int(counts[shard])


class _Draws:
    """The draws of a source in their order: all blocks once a pass, permuted, then some of them once more up to the quota."""

    def __init__(self, q: Quota, blocks: dict[int, int], seed: int, i: int):
        self.ids = np.array(sorted(blocks), dtype=np.int64)
        self.passes, self.seed = q.passes if len(self.ids) else 0, (seed, 1, i)
        self.last: list[tuple[int, int | None]] = []  # of the last pass: block and the tokens to take of it, None for all
        left = q.rest
        for b in self._order(q.passes):
            if left <= 0:
                break
            self.last.append((int(b), None if blocks[int(b)] <= left else left))
            left -= blocks[int(b)]

    def _order(self, n: int) -> np.ndarray:
        """The blocks as pass ``n``, from 0, draws them; any pass can be drawn alone."""
        return np.random.default_rng([*self.seed, n]).permutation(self.ids)

    def __len__(self) -> int:
        return self.passes * len(self.ids) + len(self.last)

    def taken(self, at: int, n: int) -> list[tuple[int, int, int, int | None]]:
        """(block, first pass from 1, number of passes, tokens to take or None) of ``n`` draws from ``at`` on.

        A block is drawn once a pass, so its passes within a segment of draws are in a row.
        """
        k, whole, end = len(self.ids), self.passes * len(self.ids), at + n
        out: dict[int, list[int]] = {}
        stop = min(end, whole)
        if at < stop:
            p0, p1 = at // k, (stop - 1) // k
            for b in self._order(p0)[at - p0 * k : stop - p0 * k]:
                out[int(b)] = [p0 + 1, 1]
            if p1 > p0:
                between = p1 - p0 - 1
                if between:
                    for b in self.ids:
                        got = out.setdefault(int(b), [p0 + 2, 0])
                        got[1] += between
                for b in self._order(p1)[: stop - p1 * k]:
                    got = out.setdefault(int(b), [p1 + 1, 0])
                    got[1] += 1
        part = self.last[max(at - whole, 0) : max(end - whole, 0)]
        return [(b, first, times, None) for b, (first, times) in out.items()] + [(b, self.passes + 1, 1, rest) for b, rest in part]


def _cut(taken: DataFrame, seed: int) -> DataFrame:
    """Of the one block of a source that is taken in part, the pages that fit, in a random order."""
    whole = taken.filter(F.col("rest").isNull()).drop("rest")
    part = taken.filter(F.col("rest").isNotNull())
    order = Window.partitionBy("s", "b", "pass").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return whole.unionByName(part.withColumn("upto", F.sum("n_tokens").over(order)).filter(F.col("upto") <= F.col("rest")).drop("upto", "rest"))


def shuffled_shards(selection: DataFrame, shards: int | None = None) -> DataFrame:
    """The selection with shard i in partition i, in its own random order; sorts spill. ``shards`` is looked up if not given."""
    if shards is None:
        shards = (selection.agg(F.max("shard")).first()[0] or 0) + 1
    return selection.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("order_key", "doc_id")


def mixture_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_pages, most_repeats) of every target, undrawn ones too."""
    per_page = selection.groupBy(source_key(F.col("source")).alias("s"), "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    got = per_page.groupBy("s").agg(F.sum("t").alias("n_tokens"), F.sum("n").alias("n_pages"), F.max("n").alias("most_repeats"))
    total = got.agg(F.sum("n_tokens").alias("all_tokens"))
    out = targets.select(source_key(F.col("source")).alias("s"), F.col("source"), F.col("target_share").cast("double").alias("target_share")).join(got, "s", "left").join(F.broadcast(total), F.lit(True), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return out.select("source", "target_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("n_tokens"), zero("n_pages"), zero("most_repeats"))


def default_vocabulary(spark: SparkSession) -> str:
    """The file named by ``graphlake.tokenizer`` in the session, else the byte-level vocabulary of the installed tokenizer files."""
    path = spark.conf.get("graphlake.tokenizer", None)
    if path:
        return path
    try:
        import public_tokenizers
    except ImportError:
        raise ValueError("set graphlake.tokenizer to the file of a byte-level vocabulary") from None
    return public_tokenizers.path("byte_bpe_50k.tiktoken")
