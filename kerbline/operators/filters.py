"""Row filters of the planning chain. Null keys and null values never pass unless a docstring says so."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.calendar import lenient_timestamp, week_start
from kerbline.functions.text import clean, house_number, unit_blank

#: First and last day of each survey phase, and the first day of its history.
PHASES = [("pilot", dt.date(2025, 10, 1), dt.date(2026, 1, 3)), ("official", dt.date(2026, 1, 10), dt.date(2026, 12, 31))]


def patches(raw: DataFrame) -> DataFrame:
    """(segment_id, date_reported, date_closed, activity_start, activity_end, week_start) of the pothole patches among raw activities.

    Dates that don't parse are null; rows without a segment are dropped.
    """
    kept = raw.where("ACTIVITY_CODE_GROUP_TEXT = 'ASPHALT' and ACTIVITY_CODE_TEXT = 'POTHOLE PATCHED (EA)'")
    date = lambda c: lenient_timestamp(F.col(c).cast("string"), "M/d/y", "M/d/y H:m")
    reported = date("NOTIFICATION_DATE")
    out = kept.select(
        clean(F.col("FUNCTIONAL_LOCATION")).alias("segment_id"), reported.alias("date_reported"), date("COMPLETION_DATE").alias("date_closed"),
        date("CREATED_ON_DATE_FOR_ACTIVITY").alias("activity_start"), date("END_DATE_FOR_ACTIVITY").alias("activity_end"), week_start(reported).alias("week_start"),
    )
    return out.where("segment_id != ''")


def in_period(df: DataFrame, ts: str, first: Column, last: Column, inclusive_end: bool = False) -> DataFrame:
    """Rows with ``first <= ts <= last``. ``last`` is a date, so by default a report of that day after midnight is out; ``inclusive_end`` keeps the day."""
    end = F.col(ts) < F.date_add(F.to_date(last), 1).cast("timestamp") if inclusive_end else F.col(ts) <= last.cast("timestamp")
    return df.where((F.col(ts) >= first.cast("timestamp")) & end)


def in_years(df: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    """Rows of the years ``first`` to ``last`` as a half-open range, which reaches the scan."""
    return df.where((F.col(ts) >= F.lit(dt.datetime(first, 1, 1))) & (F.col(ts) < F.lit(dt.datetime(last + 1, 1, 1))))


def addressable(df: DataFrame, name: str | None, number: str | None) -> DataFrame:
    """Rows with a street name and a house number other than 0: without a name column all names pass, without a number column none does."""
    if number is None:
        return df.where("false")
    kept = house_number(F.col(number)) != ""
    return df.where(kept if name is None else kept & (clean(F.col(name)) != ""))


def by_label(labelled: DataFrame, label: str, codes: list[str], mode: str, strict: bool = False) -> DataFrame:
    """Rows whose polygon label is among ``codes`` (mode "include") or not among them ("exclude").

    Rows without a label are out of an include filter and stay in an exclude filter, unless ``strict``.
    """
    listed = F.coalesce(F.col(label).isin(codes), F.lit(False))
    if mode == "include":
        return labelled.where(listed)
    return labelled.where(~listed & F.col(label).isNotNull() if strict else ~listed)


def single_homes(df: DataFrame, unit: str) -> DataFrame:
    return df.where(unit_blank(F.col(unit)))


def at_least(counts: DataFrame, column: str, low: float, high: float | None = None) -> DataFrame:
    """Rows with ``low <= column`` and, if stated, ``column <= high``."""
    kept = F.col(column) >= low
    return counts.where(kept if high is None else kept & (F.col(column) <= high))


def disjoint_groups(members: DataFrame, used: DataFrame, group: str, key: str) -> DataFrame:
    """(group) of the groups none of whose keys is used; a group without keys is dropped."""
    held = members.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    hit = held.join(used.select(key).distinct(), key, "left_semi").select(group).distinct()
    return held.select(group).distinct().join(hit, group, "left_anti")


def size_band(members: DataFrame, group: str, size: str, target: float, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """(group, total, kept): each group's total, and whether it lies in [low * target, high * target]."""
    totals = members.where(F.col(group).isNotNull()).groupBy(group).agg(F.sum(size).alias("total"))
    return totals.withColumn("kept", F.coalesce(F.col("total").between(low * target, high * target), F.lit(False)))


def phase(day: Column) -> Column:
    """Name of the survey phase of a date; null between phases."""
    out = F.lit(None).cast("string")
    for name, first, last in PHASES:
        out = F.when(day.between(F.lit(first), F.lit(last)), name).otherwise(out)
    return out


def require_phase(day: dt.date) -> tuple[str, dt.date, dt.date]:
    """The phase of a plan's date, with the bounds of its history; raises for a date outside all phases."""
    for name, first, last in PHASES:
        if first <= day <= last:
            return name, first, last
    raise ValueError(f"{day} belongs to no survey phase")


def county(df: DataFrame, code: str = "073", prefix: str = "G06") -> DataFrame:
    """Rows of one county by the first of these that the columns allow: COUNTYA, COUNTYFP or COUNTY, GISJOIN; else all rows."""
    columns = set(df.columns)
    if "COUNTYA" in columns:
        return df.where(F.expr("try_cast(COUNTYA as int)") == int(code))
    for name in ("COUNTYFP", "COUNTY"):
        if name in columns:
            return df.where(F.col(name).cast("string").isin(code, code.lstrip("0")))
    if "GISJOIN" in columns:
        return df.where(F.contains(F.col("GISJOIN"), F.lit(prefix + code)))
    return df


def to_visit(points: DataFrame) -> DataFrame:
    """Addresses that crews go to: all of other tasks, and the selected ones of door hangers."""
    door = F.coalesce(F.upper(F.col("task")) == "DH", F.lit(False))
    return points.where(~door | F.coalesce(F.col("dh_selected"), F.lit(False)))
