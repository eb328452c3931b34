"""Feature engineering as column expressions and small plans; no Python functions over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.skew import running_totals
from graphlake.storage import Rounds


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, freq): how often each value stands in a column; null is a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def _by_frequency() -> list[Column]:
    """Most frequent first, ties by value, null last among equals."""
    return [F.desc("freq"), F.asc_nulls_last("value")]


def most_common(df: DataFrame, column: str) -> DataFrame:
    """(value): the most frequent value; ties by the smaller, null loses ties. No row for an empty table."""
    return frequencies(df, column).orderBy(*_by_frequency()).limit(1).select("value")


def top_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """(rank, value, freq): the ``n`` most frequent values, all if there are fewer."""
    top = frequencies(df, column).orderBy(*_by_frequency()).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*_by_frequency())).cast("bigint").alias("rank"), "value", "freq")


def top_n_values(df: DataFrame, column: str, n: int) -> list:
    """The values of ``top_n`` as a list, for use as an enumeration."""
    return [r["value"] for r in frequencies(df, column).orderBy(*_by_frequency()).limit(n).collect()]


def top_percent(df: DataFrame, column: str, percent: float) -> DataFrame:
    """(rank, value, freq): the shortest list of most frequent values that covers more than ``percent`` of the rows.

    Frequencies are folded to one row a value first. Values are numbered by
    their place in the order of frequency and value, over cuts of that order,
    so that very many values of one frequency do not meet in one task.
    """
    store = Rounds(df.sparkSession, "top-percent")
    freq, seen = store.write(frequencies(df, column).withColumn("_less", -F.col("freq")), n=F.count(F.lit(1)), total=F.sum("freq"))
    placed = running_totals(store, freq, ["_less", "value"], {"_rows": F.col("freq"), "_values": F.lit(1)}, seen["n"])
    return placed.filter(F.col("_rows") <= (seen["total"] or 0) * percent).select((F.col("_values") + 1).cast("bigint").alias("rank"), "value", "freq")


def binarize(x: Column, threshold: float, positive: float = 1, negative: float = 0) -> Column:
    """``positive`` from the threshold on, ``negative`` below, null for null."""
    return F.when(x >= threshold, F.lit(positive)).when(x < threshold, F.lit(negative))


def onehot_encode(x: Column, enum: Sequence, with_others: bool = False) -> Column:
    """Array of 0 and 1 with a place for each value of ``enum``, and one more for all others if asked; null for null."""
    places = [F.when(x == F.lit(e), 1).otherwise(0) for e in enum]
    if with_others:
        places.append(F.when(x.isin(*enum), 0).otherwise(1) if enum else F.lit(1))
    return F.when(x.isNotNull(), F.array(*places) if places else F.array().cast("array<int>"))


def onehot_ids(x: Column, n: int, with_others: bool = False) -> Column:
    """``onehot_encode`` of the ids 1 to ``n``."""
    hot = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i == x, 1).otherwise(0))
    if with_others:
        hot = F.concat(hot, F.array(F.when(x.between(1, n), 0).otherwise(1)))
    return F.when(x.isNotNull(), hot)


def impute(df: DataFrame, column: str, how: str, constant: float | None = None) -> DataFrame:
    """The table with nulls of a column dropped ('drop') or replaced by a 'constant', or by the 'mode', 'max', 'min', 'avg' or 'median' of the others."""
    if how == "drop":
        return df.filter(F.col(column).isNotNull())
    if how == "constant":
        return df.withColumn(column, F.coalesce(column, F.lit(constant)))
    if how == "mode":
        one = most_common(df.filter(F.col(column).isNotNull()), column).select(F.col("value").alias("_fill"))
    else:
        fold = {"max": F.max, "min": F.min, "avg": F.avg, "median": F.median}[how]
        one = df.agg(fold(column).alias("_fill"))
    # one row, so the broadcast has a fixed size
    return df.join(F.broadcast(one), how="left").withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def _scaled(df: DataFrame, columns: Sequence[str], stats, value) -> DataFrame:
    one = df.agg(*(e.alias(f"_{k}_{c}") for c in columns for k, e in stats(c).items()))
    out = df.join(F.broadcast(one))
    for c in columns:
        out = out.withColumn(c, value(F.col(c), {k: F.col(f"_{k}_{c}") for k in stats(c)}))
    return out.select(*df.columns)


def standardize(df: DataFrame, *columns: str) -> DataFrame:
    """(x - mean) / sample deviation; null if the deviation is 0."""
    return _scaled(df, columns, lambda c: {"m": F.avg(c), "s": F.stddev_samp(c)}, lambda x, s: (x - s["m"]) / F.nullif(s["s"], F.lit(0.0)))


def l1_normalize(df: DataFrame, *columns: str) -> DataFrame:
    """x / sum of x; null if the sum is 0."""
    return _scaled(df, columns, lambda c: {"t": F.sum(c).cast("double")}, lambda x, s: x / F.nullif(s["t"], F.lit(0.0)))


def minmax(df: DataFrame, *columns: str) -> DataFrame:
    """(x - min) / (max - min); 0 if all values are equal."""
    return _scaled(df, columns, lambda c: {"lo": F.min(c), "hi": F.max(c)}, lambda x, s: F.when(s["hi"] == s["lo"], x * 0.0).otherwise((x - s["lo"]) / (s["hi"] - s["lo"])))
