"""What past plans have used, and the latest of them before a date. A plan has (date, task, bundle_id, bundle_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between(plans: DataFrame, first: Column | None = None, last: Column | None = None, but: Column | None = None) -> DataFrame:
    """Plans dated in [first, last], without the date ``but``; plans without a date are dropped."""
    kept = plans.where("date is not null")
    for bound, test in ((first, lambda b: F.col("date") >= b), (last, lambda b: F.col("date") <= b), (but, lambda b: F.col("date") != b)):
        kept = kept if bound is None else kept.where(test(bound))
    return kept


def used_bundles(plans: DataFrame) -> DataFrame:
    """(bundle_id, dh, d2ds, first_date, n_dates): each bundle used before and for what; tasks are told whatever their case."""
    task = F.upper(F.trim("task"))
    kept = plans.where("bundle_id is not null")
    return kept.groupBy("bundle_id").agg(
        F.bool_or(F.coalesce(task == "DH", F.lit(False))).alias("dh"), F.bool_or(F.coalesce(task == "D2DS", F.lit(False))).alias("d2ds"),
        F.min("date").alias("first_date"), F.count_distinct("date").alias("n_dates"),
    )


def usage_by_date(plans: DataFrame) -> DataFrame:
    """(date, task, n_bundles, bundles): sorted distinct bundles of each date and task; a date's plan is small."""
    found = F.sort_array(F.collect_set("bundle_id"))
    return plans.where("bundle_id is not null").groupBy("date", F.upper(F.trim("task")).alias("task")).agg(F.size(found).cast("bigint").alias("n_bundles"), F.array_join(found.cast("array<string>"), ",").alias("bundles"))


def previous_plan(plans: DataFrame, day: Column) -> DataFrame:
    """The rows of the latest plan before ``day``; the date is found by one aggregate and joined as a single row."""
    latest = plans.where(F.col("date") < day).agg(F.max("date").alias("_latest"))
    return plans.join(F.broadcast(latest), F.col("date") == F.col("_latest")).drop("_latest")


def previous_conditional(plans: DataFrame, day: Column, eligible_by_date: DataFrame) -> DataFrame:
    """(bundle_id): door-hanger bundles of the latest plan before ``day`` that were eligible on that plan's date."""
    dh = previous_plan(plans, day).where(F.upper(F.trim("task")) == "DH").select("date", "bundle_id")
    return dh.join(eligible_by_date.select("date", "bundle_id"), ["date", "bundle_id"], "left_semi").select("bundle_id").distinct()


def eligible_weeks(activities: DataFrame, members: DataFrame, weeks: int = 1, key: str = "segment_id", group: str = "bundle_id") -> DataFrame:
    """(week_start, group): groups with a report in the week ``weeks`` before; one join for all weeks, shifted."""
    seen = activities.where(F.col(key).isNotNull()).select(key, "week_start").distinct()
    named = seen.join(members.where(F.col(group).isNotNull()).select(key, group).distinct(), key)
    return named.select(F.date_add("week_start", 7 * weeks).alias("week_start"), group).distinct()


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of each key's last row in ``order``, the larger value on ties, as a dictionary filled row by row has it."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, value))[value].alias(value))


def segment_lists(members: DataFrame) -> DataFrame:
    """(bundle_id, n, segments): sorted distinct segments of each bundle; a bundle is a day's work."""
    kept = members.where("bundle_id is not null and segment_id is not null").select("bundle_id", "segment_id").distinct()
    return kept.groupBy("bundle_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("segment_id")).alias("segments"))


def bundle_metadata(members: DataFrame, activities: DataFrame, day: Column) -> DataFrame:
    """(bundle_id, num_segments, num_potholes_in_preceding_week, segments_with_potholes) for the week before ``day``."""
    hits = activities.where(F.col("week_start") == F.date_sub(day, 7)).groupBy("segment_id").agg(F.count("*").alias("n"))
    rows = members.where("bundle_id is not null").select("bundle_id", "segment_id").distinct().join(hits, "segment_id", "left")
    hit = F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.col("segment_id").cast("string"))))
    return rows.groupBy("bundle_id").agg(F.count("*").alias("num_segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_potholes_in_preceding_week"), F.array_join(hit, ",").alias("segments_with_potholes"))


def weekly_assignments(plan: DataFrame) -> DataFrame:
    """(date, total_assignments, d2ds_count, dh_count)."""
    survey = F.coalesce(F.upper(F.trim("task")) == "D2DS", F.lit(False))
    return plan.groupBy("date").agg(F.count("*").alias("total_assignments"), F.count_if(survey).alias("d2ds_count"), F.count_if(~survey).alias("dh_count"))


def diagnostics(layers: dict[str, DataFrame], events: DataFrame, unit: str, ts: str) -> DataFrame:
    """One row: rows of each layer, events, distinct units and the span of days."""
    row = events.agg(F.count("*").alias("events"), F.count_distinct(unit).alias("units"), F.min(F.to_date(ts)).alias("first_day"), F.max(F.to_date(ts)).alias("last_day"))
    for name, layer in layers.items():
        row = row.crossJoin(F.broadcast(layer.agg(F.count("*").alias(name))))
    return row
