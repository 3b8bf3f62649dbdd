"""Windows over histories: gaps, islands, carried states, balanced selection, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, key: str, clock: str) -> DataFrame:
    """(key, runs, latest, max_gap_s): the latest clock and the largest gap between consecutive ones.

    Rows are ordered within a key's days; only the first and last clock of each day meet in one place for a key.
    """

    def seconds(later: Column, earlier: Column) -> Column:
        return F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))

    rows = df.select(key, clock, F.to_date(clock).alias("_day"))
    inner = seconds(F.col(clock), F.lag(clock).over(Window.partitionBy(key, "_day").orderBy(clock)))
    days = rows.withColumn("_gap", inner).groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"), F.min(clock).alias("_first"), F.max(clock).alias("_last"), F.max("_gap").alias("_gap"))
    between = seconds(F.col("_first"), F.lag("_last").over(Window.partitionBy(key).orderBy("_day")))
    return days.withColumn("_gap", F.greatest("_gap", between)).groupBy(key).agg(F.sum("_n").alias("runs"), F.max("_last").alias("latest"), F.max("_gap").alias("max_gap_s"))


def islands(df: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """Run-length encoding: (keys, island, state, length, first, last) of consecutive equal states; nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    change = (first | ~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int")
    numbered = df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "island").agg(F.min(state).alias("state"), F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def carry_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null ``value`` up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def balanced_top(df: DataFrame, group: str, order: list[Column], n: int, ties: list[Column]) -> DataFrame:
    """``n`` rows dealt round-robin over the groups, each in ``order``: a group's k-th row comes before any group's k+1-th.

    Only the first ``n`` rows of a group can be chosen, so the ranking keeps no more of it.
    """
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= n)
    return ranked.orderBy("turn", *ties).limit(n)


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page of a total order, cut off by the engine's top-k (offset and limit)."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)
