"""References to records that do not exist, and what hangs below them (problem 3).

A reference is a direct orphan if no lifetime of the referenced key covers the
moment of the referring row. Rows that reference a record which itself rests
on an orphan are inherited orphans: the direct ones are pushed down the
foreign-key graph by repeated semi-joins until a round finds nobody new.

Where records have one parent each, every round follows links of twice the
length, so a chain of depth d takes log2(d) rounds instead of d. A record of
several parents keeps its pairs as they are, and links of others end at it: no
round has more links than the pairs it began with. A round without new records
proves the fixpoint, on cycles too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.storage import Rounds


@dataclass(frozen=True)
class Hierarchy:
    """How the rows of a table are parents of each other: the rows with ``member`` provide
    the record ``provides`` and depend on the record ``depends`` in column ``endpoint``."""

    provides: Column
    depends: Column
    endpoint: str
    member: Column


def direct_orphans(rows: DataFrame, row_key: Column, refs: Sequence[str], at: Column, parents: DataFrame, parent_key: Column, valid_from: Column, valid_to: Column) -> DataFrame:
    """(row_key, endpoint, ref, at) of each non-null reference that no lifetime covers.

    A lifetime covers a moment t if valid_from <= t and valid_to is null or
    > t; a null valid_from covers nothing, and nothing covers a row whose
    moment is null. Rows delivered again give a result row per delivery.

    Both ends go through one join, so the parents are shuffled once. The
    anti-join keeps the large side splittable: a hot key is cut into pieces by
    the adaptive skew join, with the few lifetimes of the key sent to each.
    """
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("e"), F.col(c).cast("bigint").alias("ref")) for k, c in enumerate(refs))))
    flat = rows.select(row_key.alias("row_key"), at.alias("at"), ends.alias("x")).select("row_key", "at", F.col("x.e").alias("e"), F.col("x.ref").alias("ref")).filter(F.col("ref").isNotNull())
    life = parents.select(parent_key.cast("bigint").alias("p_key"), valid_from.alias("p_from"), valid_to.alias("p_to")).filter(F.col("p_key").isNotNull() & F.col("p_from").isNotNull())
    covered = (F.col("ref") == F.col("p_key")) & (F.col("p_from") <= F.col("at")) & (F.col("p_to").isNull() | (F.col("p_to") > F.col("at")))
    names = F.array(*map(F.lit, refs))
    return flat.join(life, covered, "left_anti").select("row_key", F.element_at(names, F.col("e") + 1).alias("endpoint"), "ref", "at")


def orphan_cascade(rows: DataFrame, row_key: Column, refs: Sequence[str], at: Column, parents: DataFrame, parent_key: Column, valid_from: Column, valid_to: Column, hierarchy: Hierarchy | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(row_key, endpoint, at, kind), kind 'direct' or 'inherited', distinct.

    A reference that is a direct orphan is not listed as inherited too. Null
    keys reference nothing. Empty tables give an empty result; without
    parents every reference is direct.
    """
    spark = rows.sparkSession
    store = Rounds(spark, "orphans")
    found = direct_orphans(rows, row_key, refs, at, parents, parent_key, valid_from, valid_to)
    direct, _ = store.write(found.select("row_key", "endpoint", "at").distinct())
    out = direct.withColumn("kind", F.lit("direct"))
    if hierarchy is None:
        return out
    member = rows.filter(hierarchy.member).select(row_key.alias("row_key"), hierarchy.provides.cast("bigint").alias("key"), hierarchy.depends.cast("bigint").alias("ptr"), at.alias("at")).filter(F.col("ptr").isNotNull())
    member, _ = store.write(member.distinct())
    parents = member.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("ptr").alias("ptr"), (F.min("ptr") == F.max("ptr")).alias("one"))
    parents, _ = store.write(parents)
    jumps = parents.filter("one").select("key", "ptr")
    # records of several parents are followed one link a round, by all of their pairs
    several = member.select("key", "ptr").join(parents.filter("not one").select("key"), "key", "left_semi")
    hit, n = store.write(member.join(direct.select("row_key"), "row_key", "left_semi").filter(F.col("key").isNotNull()).select("key").distinct(), n=F.count(F.lit(1)))
    frontier_found = n["n"]
    for _ in range(max_rounds):
        if not frontier_found:
            break
        above = hit.select(F.col("key").alias("ptr"))
        new = jumps.unionAll(several).join(above, "ptr", "left_semi").select("key").distinct().join(hit, "key", "left_anti")
        fresh, n = store.write(new, n=F.count(F.lit(1)))
        frontier_found = n["n"]
        if not frontier_found:
            store.drop(fresh, jumps)
            break
        both, _ = store.write(hit.unionAll(fresh))
        # one row a key on the right, so the long side on the left can be split where many records share a parent
        up = jumps.select(F.col("key").alias("ptr"), F.col("ptr").alias("far"))
        jumped, _ = store.write(jumps.join(up, "ptr", "left").select("key", F.coalesce("far", "ptr").alias("ptr")))
        store.drop(hit, fresh, jumps)
        hit, jumps = both, jumped
    else:
        raise RuntimeError(f"orphans are still found after {max_rounds} rounds")
    inherited = (
        member.join(hit.select(F.col("key").alias("ptr")), "ptr", "left_semi")
        .select("row_key", F.lit(hierarchy.endpoint).alias("endpoint"), "at")
        .distinct()
        .join(direct, ["row_key", "endpoint"], "left_anti")
        .withColumn("kind", F.lit("inherited"))
    )
    return out.unionByName(inherited)


def orphan_report(cascade: DataFrame, table_name: str) -> DataFrame:
    """(table_name, endpoint, period, kind, n_rows): orphans per table, end and month."""
    return cascade.groupBy("endpoint", F.date_format("at", "yyyy-MM").alias("period"), "kind").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(table_name).alias("table_name"), "endpoint", "period", "kind", "n_rows")
