"""Per-key results when a few keys own most rows (problem 5).

Each task first folds its rows into a bounded hash table of mergeable states,
which spills when it is full; only the folded states are shuffled. Distinct
neighbours are folded on (key, neighbour) first, so a hot key is spread over
all tasks by its neighbours, and the second fold has one row a task and key.
Spark's algebraic aggregates do exactly this, so the operator is a plan of
built-in aggregates and needs no salt, no Python and no broadcast that grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.storage import Rounds


@dataclass(frozen=True)
class KeyColumn:
    """A key column of a table with the column its neighbours stand in."""

    table_name: str
    column_name: str
    frame: DataFrame
    key: Column
    neighbour: Column


def key_stats(columns: Sequence[KeyColumn]) -> DataFrame:
    """(table_name, column_name, vid, n_rows, n_neighbours), one row per key.

    Rows count as delivered, repeats included. A null key has a row of its
    own, so that the row counts of a column add up to its table; a null
    neighbour counts as a row and not as a neighbour. An empty table has no
    rows here. Only the two columns are read, whatever else the table has.
    """
    parts = []
    for code, c in enumerate(columns):
        parts.append(c.frame.select(F.lit(code).cast("tinyint").alias("code"), c.key.cast("bigint").alias("vid"), c.neighbour.cast("bigint").alias("nbr")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    stats = rows.groupBy("code", "vid").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("nbr").alias("n_neighbours"))
    return stats.select(_named("code", [c.table_name for c in columns]).alias("table_name"), _named("code", [c.column_name for c in columns]).alias("column_name"), "vid", "n_rows", "n_neighbours")


def _named(code: str, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col(code).cast("int") + 1)


def key_totals(columns: Sequence[KeyColumn]) -> DataFrame:
    """(table_name, column_name, total): rows of each table, one row a key column; no column is read."""
    out = None
    for c in columns:
        part = c.frame.agg(F.count(F.lit(1)).alias("total")).select(F.lit(c.table_name).alias("table_name"), F.lit(c.column_name).alias("column_name"), "total")
        out = part if out is None else out.unionAll(part)
    return out


def heavy_keys(stats: DataFrame, share: float = 0.01, totals: DataFrame | None = None) -> DataFrame:
    """The keys of ``key_stats`` that own at least ``share`` of their table's rows; null is no key.

    ``totals`` from ``key_totals`` spare folding the rows a second time.
    """
    if totals is None:
        totals = stats.groupBy("table_name", "column_name").agg(F.sum("n_rows").alias("total"))  # one row a key column
    return (
        stats.join(F.broadcast(totals), ["table_name", "column_name"])
        .filter(F.col("vid").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("total")))
        .drop("total")
    )


#: Rows of one key that a single task may hold.
HOT_ROWS = 1_000_000
#: Keys that can have more rows than that are at most so many, whatever the table: the bound of what is broadcast.
MOST_HOT = 10_000


def hot_bound(total: int) -> int:
    """Rows from which a key is hot in a table of ``total`` rows; at most ``MOST_HOT`` keys can be."""
    return max(HOT_ROWS, -(-total // MOST_HOT))


def join_to_keys(rows: DataFrame, keys: DataFrame, key: str, total: int, count: str | None = None) -> DataFrame:
    """``rows`` with the columns of their key in ``keys``, which has one row a key; an inner join that splits hot keys.

    ``total`` is the number of rows, ``count`` the column of ``keys`` with the
    rows of each key; it may be left out where no key can be hot. Rows of hot
    keys stay where they are and get their key by a broadcast of at most
    ``MOST_HOT`` rows; only the others are shuffled. ``keys`` should be a
    written table, since it is read twice.
    """
    if count is None or total <= HOT_ROWS:
        return rows.join(keys, key)
    bound = hot_bound(total)
    hot = F.broadcast(keys.filter(F.col(count) > bound))
    cold = rows.join(F.broadcast(keys.filter(F.col(count) > bound).select(key)), key, "left_anti").join(keys.filter(F.col(count) <= bound), key)
    return rows.join(hot, key).unionByName(cold)


#: Rows that one task sorts for a running total, about.
ROWS_PER_CUT = 100_000


def running_totals(store: Rounds, rows: DataFrame, order: Sequence[str], totals: dict[str, Column], n: int, per_cut: int | None = None) -> DataFrame:
    """``rows`` with the sum of each value of ``totals`` over all rows before it in the order of some columns, nulls last.

    The rows are cut by range of the order, so that no key, however hot, gathers
    in one task, and summed within the cuts and over the cuts. ``n`` is their
    number; few rows are one cut and need no table.
    """
    by = [F.asc_nulls_last(c) for c in order]
    cuts = max(1, -(-n // (per_cut or ROWS_PER_CUT)))
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    values = rows.select("*", *(v.alias(f"_v_{k}") for k, v in totals.items()))
    kept = rows.columns
    if cuts == 1:
        w = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return values.select(*kept, *(before(f"_v_{k}", w).alias(k) for k in totals))
    parts, _ = store.write(values.repartitionByRange(cuts, *by).withColumn("_cut", F.spark_partition_id()))
    over = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)  # one row a cut
    starts = parts.groupBy("_cut").agg(*(F.sum(f"_v_{k}").alias(k) for k in totals)).select("_cut", *(before(k, over).alias(f"_s_{k}") for k in totals))
    w = Window.partitionBy("_cut").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.select(*kept, "_cut", *(before(f"_v_{k}", w).alias(k) for k in totals))
    return inner.join(F.broadcast(starts), "_cut").select(*kept, *((F.col(k) + F.col(f"_s_{k}")).alias(k) for k in totals))
