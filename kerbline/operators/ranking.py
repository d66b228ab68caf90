"""Ranked choices per group: lags, extremes, first rows and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lagged(df: DataFrame, unit: str, order: str, *columns: str) -> DataFrame:
    """Each column's value in the unit's row before, as ``<column>_lag``; null in the first row."""
    w = Window.partitionBy(unit).orderBy(order)
    return df.withColumns({f"{c}_lag": F.lag(c).over(w) for c in columns})


def extremes(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, lowest, highest): the keys of the group's smallest and largest value; ties go to the smaller key.

    Aggregates with map-side combination, so a large group is never sorted. Null values are left out.
    """
    low = F.min(F.struct(F.col(value), F.col(key)))[key]
    high = F.min(F.struct(-F.col(value), F.col(key)))[key]
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(low.alias("lowest"), high.alias("highest"))


def first_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """One row of each group, the first in the stated order, which should leave no ties."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def fallback(df: DataFrame, group: str, fits: Column, *order: Column) -> DataFrame:
    """The first row of each group that fits, else its first row at all; ``fits`` tells which it is."""
    return first_per_group(df.withColumn("fits", F.coalesce(fits, F.lit(False))), group, F.col("fits").desc(), *order)


def sequence(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``seq`` from 1 and ``start_flag`` for the first row of each group, in the stated order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("seq", place).withColumn("start_flag", (F.col("seq") == 1).cast("int"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows: each task keeps its own first, then those meet."""
    return df.orderBy(*order).limit(k)


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def either(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()
