"""Event aggregates, segment-week panels and what is estimated on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.calendar import week_start, whole_days
from kerbline.runtime import materialise


def weekly_counts(events: DataFrame, unit: str, ts: str) -> DataFrame:
    """(unit, week_start, n_events): the only shuffle is on the grouping key, after partial counts."""
    return events.groupBy(F.col(unit).alias("unit"), week_start(F.col(ts)).alias("week_start")).agg(F.count("*").alias("n_events"))


def _grid(seen: DataFrame) -> DataFrame:
    """Every unit of ``seen`` with every week from the first to the last; the calendar is one row, and each unit explodes it."""
    span = seen.agg(F.min("week_start").alias("first"), F.max("week_start").alias("last"))
    weeks = span.select(F.expr("sequence(first, last, interval 7 days)").alias("weeks"))
    return seen.select("unit").distinct().join(F.broadcast(weeks)).select("unit", F.explode("weeks").alias("week_start"))


def dense_panel(events: DataFrame, unit: str, ts: str, closed: Column) -> DataFrame:
    """(unit, week_start, n_events, y, r) for each unit with an event and each week.

    ``y`` marks weeks with events; ``r`` is 1 where every event of the week is ``closed``, and null without events. Rows without unit or date are dropped.
    """
    kept = events.where(F.col(unit).isNotNull() & F.col(ts).isNotNull())
    done = F.coalesce(closed, F.lit(False)).cast("int")
    seen = kept.groupBy(F.col(unit).alias("unit"), week_start(F.col(ts)).alias("week_start")).agg(F.count("*").alias("n_events"), F.min(done).alias("r"))
    full = _grid(seen).join(seen, ["unit", "week_start"], "left")
    return full.select("unit", "week_start", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.col("n_events").isNotNull().cast("int").alias("y"), "r")


def closed_in_time(reported: Column, closed: Column) -> Column:
    """Whether an event was closed by midnight at the start of its week's Friday; an open one was not."""
    return F.coalesce(closed <= F.date_add(week_start(reported), 6).cast("timestamp"), F.lit(False))


def report_panel(activities: DataFrame, unit: str = "segment_id") -> DataFrame:
    """The dense panel of reports (reported, closed): ``r`` is 1 where all of the week's reports were closed in time."""
    return dense_panel(activities, unit, "reported", closed_in_time(F.col("reported"), F.col("closed")))


def two_way_effects(panel: DataFrame, value: str) -> DataFrame:
    """(unit, week_start, unit_effect, week_effect, fitted) of a balanced panel in closed form.

    Means come from the rows with a value other than 0 and the size of the grid; one aggregate by unit and one by week.
    """
    per_unit = panel.groupBy("unit").agg(F.avg(value).alias("unit_mean"), F.count("*").alias("weeks"))
    per_week = panel.groupBy("week_start").agg(F.avg(value).alias("week_mean"))
    grand = per_unit.agg(F.avg("unit_mean").alias("grand"))
    rows = panel.select("unit", "week_start").join(per_unit.select("unit", "unit_mean"), "unit").join(F.broadcast(per_week), "week_start").join(F.broadcast(grand))
    return rows.select(
        "unit", "week_start", (F.col("unit_mean") - F.col("grand")).alias("unit_effect"), (F.col("week_mean") - F.col("grand")).alias("week_effect"),
        (F.col("unit_mean") + F.col("week_mean") - F.col("grand")).alias("fitted"),
    )


def count_effects(events: DataFrame, unit: str, ts: str) -> DataFrame:
    """(unit, week_start, unit_effect, week_effect, fitted) of the dense panel's event counts, without building the panel.

    Sums by unit and by week come from the weekly counts, one scan; the calendar with its means is one row, which each unit explodes.
    """
    seen = events.where(F.col(unit).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(unit).alias("unit"), week_start(F.col(ts)).alias("week_start")).agg(F.count("*").alias("n"))
    units = seen.groupBy("unit").agg(F.sum("n").alias("s"))
    weeks = seen.groupBy("week_start").agg(F.sum("n").alias("s"))
    whole = units.agg(F.count("*").alias("units"), F.sum("s").alias("total"))
    calendar = weeks.agg(F.expr("sequence(min(week_start), max(week_start), interval 7 days)").alias("days"), F.map_from_entries(F.collect_list(F.struct("week_start", "s"))).alias("sums"))
    one = calendar.crossJoin(F.broadcast(whole)).select(
        F.transform("days", lambda d: F.struct(d.alias("week_start"), (F.coalesce(F.try_element_at("sums", d), F.lit(0)) / F.col("units")).alias("mean"))).alias("weeks"),
        F.size("days").alias("n"), (F.col("total") / F.col("units") / F.size("days")).alias("grand"),
    )
    rows = units.join(F.broadcast(one)).select("unit", (F.col("s") / F.col("n")).alias("u"), "grand", F.explode("weeks").alias("w"))
    unit_effect, week_effect = F.col("u") - F.col("grand"), F.col("w.mean") - F.col("grand")
    return rows.select("unit", F.col("w.week_start").alias("week_start"), unit_effect.alias("unit_effect"), week_effect.alias("week_effect"), (F.col("u") + week_effect).alias("fitted"))


def two_way_projections(panel: DataFrame, value: str, rounds: int = 100, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame, float]:
    """(unit effects, week effects, R2) of any panel by alternating projections; both effects have mean zero over the rows.

    Each round is two aggregates over the panel; only a maximal change reaches the driver, and effects are written each fourth round.
    """
    rows = panel.where(F.col(value).isNotNull()).select("unit", "week_start", F.col(value).cast("double").alias("v"))
    grand = rows.agg(F.avg("v")).first()[0] or 0.0
    weeks = materialise(rows.select("week_start").distinct().withColumn("b", F.lit(0.0)), "effects")
    units = None
    for i in range(rounds):
        units = rows.join(weeks, "week_start").groupBy("unit").agg(F.avg(F.col("v") - F.lit(grand) - F.col("b")).alias("a"))
        fresh = materialise(rows.join(units, "unit").groupBy("week_start").agg(F.avg(F.col("v") - F.lit(grand) - F.col("a")).alias("b")), "effects")
        moved = fresh.alias("x").join(weeks.alias("y"), "week_start").agg(F.max(F.abs(F.col("x.b") - F.col("y.b")))).first()[0]
        weeks = fresh
        if moved is None or moved < tolerance:
            break
    units = materialise(rows.join(weeks, "week_start").groupBy("unit").agg(F.avg(F.col("v") - F.lit(grand) - F.col("b")).alias("a")), "effects")
    fitted = rows.join(units, "unit").join(weeks, "week_start").withColumn("e", F.col("v") - F.lit(grand) - F.col("a") - F.col("b"))
    s = fitted.agg(F.sum(F.col("e") * F.col("e")), F.var_pop("v") * F.count("*"), F.avg("a"), F.avg("b")).first()
    r2 = 1 - s[0] / s[1] if s[1] else 0.0
    centred = lambda d, c, m: d.withColumn(c, F.col(c) - F.lit(m or 0.0))
    return centred(units, "a", s[2]).withColumnRenamed("a", "unit_effect"), centred(weeks, "b", s[3]).withColumnRenamed("b", "week_effect"), r2


def week_effects(panel: DataFrame) -> DataFrame:
    """(week_start, r_hat): mean of r over the week's rows with reports, held in [0, 1]."""
    return panel.where("y = 1").groupBy("week_start").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("r"))).alias("r_hat"))


def seasonal(panel: DataFrame, value: str) -> DataFrame:
    """(week_of_year, year, mean) by ISO week and calendar year."""
    return panel.groupBy(F.weekofyear("week_start").alias("week_of_year"), F.year("week_start").alias("year")).agg(F.avg(value).alias("mean"))


def seasonal_pivot(panel: DataFrame, value: str, years: list[int]) -> DataFrame:
    """One row per ISO week, one column ``y<year>`` per calendar year; the years are stated, so no pass looks for them."""
    rows = panel.select(F.weekofyear("week_start").alias("week_of_year"), F.year("week_start").alias("year"), F.col(value))
    wide = rows.groupBy("week_of_year").pivot("year", years).agg(F.avg(value))
    return wide.select("week_of_year", *(F.col(str(y)).alias(f"y{y}") for y in years))


def weekly_summary(panel: DataFrame) -> DataFrame:
    """(week_start, potholes, total_segments, pothole_rate, fixed, fix_rate); a week without reports has no fix rate."""
    fixed = F.sum(F.coalesce("r", F.lit(0)))
    return panel.groupBy("week_start").agg(
        F.sum("n_events").alias("potholes"), F.count("*").alias("total_segments"), F.avg("y").alias("pothole_rate"), fixed.alias("fixed"), F.try_divide(fixed, F.sum("y")).alias("fix_rate")
    )


def variation_labels(panel: DataFrame) -> DataFrame:
    """(week_start, n_segments, n_fixed, n_unfixed, pct_fixed, pct_unfixed, issue, has_variation): weeks by how many of the segments with reports are fixed."""
    weekly = panel.groupBy("week_start").agg(F.sum("y").alias("n_segments"), F.sum(F.coalesce("r", F.lit(0))).alias("n_fixed"))
    n, fixed = F.col("n_segments"), F.col("n_fixed")
    issue = F.when(n == 0, "no_potholes").when(fixed == 0, "all_unfixed").when(fixed == n, "all_fixed").otherwise("good_variation")
    out = weekly.withColumn("n_unfixed", n - fixed).withColumn("pct_fixed", F.try_divide(fixed, n) * 100).withColumn("pct_unfixed", F.try_divide(n - fixed, n) * 100)
    return out.withColumn("issue", issue).withColumn("has_variation", issue == "good_variation")


def variation_splits(labels: DataFrame, shares: list[float]) -> DataFrame:
    """(issue, weeks, one column per share k): how many weeks have between k and 1 - k of their segments fixed."""
    inside = [F.count_if(F.col("pct_fixed").between(100 * k, 100 * (1 - k))).alias(f"split_{int(100 * k)}") for k in shares]
    return labels.groupBy("issue").agg(F.count("*").alias("weeks"), *inside)


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's group total without the row itself; totals are aggregated before the join, so a large group isn't sorted in one task."""
    sums = df.groupBy(F.col(group).alias("_g")).agg(F.sum(value).alias("_total"))
    return df.join(sums, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("others", F.col("_total") - F.col(value)).drop("_g", "_total")


def running(weekly: DataFrame, order: str, **columns: str) -> DataFrame:
    """``weekly`` with cumulative sums ``name=column`` in ``order``. One row per week: the only sort of one task is over a calendar."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return weekly.withColumns({name: F.sum(c).over(w) for name, c in columns.items()})


def cumulative_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` with ``cume``: the share of the group's rows at or below each row's value.

    Rows are counted by value, the distinct values of all groups are cut into ranges, sums within a range are windows, and each range adds the total of those before
    it. Works for few large groups, as no task holds a whole group.
    """
    counted = df.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    placed = counted.repartitionByRange("_g", "_v").withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p", "_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = materialise(placed.withColumn("_s", F.sum("_c").over(inside)), "ranges")
    sums = local.groupBy("_g", "_p").agg(F.sum("_c").alias("_t"))
    before = sums.select(F.col("_g").alias("_bg"), F.col("_p").alias("_bp"), F.coalesce(F.sum("_t").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    whole = sums.groupBy(F.col("_g").alias("_wg")).agg(F.sum("_t").alias("_n"))
    told = local.join(F.broadcast(before), F.col("_g").eqNullSafe(F.col("_bg")) & (F.col("_p") == F.col("_bp"))).join(F.broadcast(whole), F.col("_g").eqNullSafe(F.col("_wg")))
    told = told.select("_g", "_v", ((F.col("_s") + F.col("_before")) / F.col("_n")).alias("cume"))
    return df.join(told, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def week_metrics(activities: DataFrame, week: Column, suffix: str) -> DataFrame:
    """(segment_id, has_pothole_*, pothole_count_*, all_potholes_fixed_*, share_fixed_*, avg_days_to_fix_*, max_days_to_fix_*) of one week."""
    rows = activities.where((F.col("week_start") == week) & F.col("segment_id").isNotNull())
    done, days = F.col("closed").isNotNull(), whole_days(F.col("reported"), F.col("closed"))
    n, fixed = F.count("*"), F.count_if(done)
    return rows.groupBy("segment_id").agg(
        F.lit(1).alias(f"has_pothole_{suffix}"), n.alias(f"pothole_count_{suffix}"), (fixed == n).cast("int").alias(f"all_potholes_fixed_{suffix}"), (fixed / n).alias(f"share_fixed_{suffix}"),
        F.coalesce(F.avg(days), F.lit(0.0)).alias(f"avg_days_to_fix_{suffix}"), F.coalesce(F.max(days), F.lit(0)).alias(f"max_days_to_fix_{suffix}"),
    )


def segment_analysis(routes: DataFrame, activities: DataFrame, day: Column) -> DataFrame:
    """One row per distinct (segment, bundle, task, date) of the routes with this and last week's metrics, and the bundle's other reports.

    Segments without reports count 0; their days columns are 0 if the week has any report at all on a routed segment, else null. A segment that is
    routed for two tasks counts twice in its bundle's total.
    """
    steps = routes.select("segment_id", "bundle_id", "task", "date").distinct()
    task = F.upper("task")
    out = steps.withColumn("treatment_status_dh", F.when(task == "DH", "DH").otherwise("")).withColumn("survey_status_d2ds", F.when(task == "D2DS", "D2DS").otherwise(""))
    for suffix, week in (("this_week", day), ("last_week", F.date_sub(day, 7))):
        out = out.join(week_metrics(activities, week, suffix), "segment_id", "left")
        known = out.agg(F.bool_or(F.col(f"avg_days_to_fix_{suffix}").isNotNull()).alias("_any"))
        zero = [f"has_pothole_{suffix}", f"pothole_count_{suffix}", f"all_potholes_fixed_{suffix}", f"share_fixed_{suffix}"]
        days = [f"avg_days_to_fix_{suffix}", f"max_days_to_fix_{suffix}"]
        out = out.crossJoin(F.broadcast(known)).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero} | {c: F.when(F.col("_any"), F.coalesce(F.col(c), F.lit(0))) for c in days}).drop("_any")
    named = leave_one_out(out, "bundle_id", "pothole_count_this_week")
    return named.withColumnRenamed("others", "bundle_pothole_count_excl_segment")


def eligibility_by_week(eligible: DataFrame) -> DataFrame:
    """(week_start, eligible_bundles)."""
    return eligible.groupBy("week_start").agg(F.count_distinct("bundle_id").alias("eligible_bundles"))


def distribution(weekly: DataFrame, value: str, at_least: list[int]) -> DataFrame:
    """One row: mean, median, extremes, sample deviation, percentiles and how many weeks reach each threshold. One row per week comes in."""
    tenth = [F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (10, 25, 75, 90, 95, 99)]
    reach = [F.count_if(F.col(value) >= k).alias(f"weeks_{k}") for k in at_least]
    return weekly.agg(F.count("*").alias("weeks"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("smallest"), F.max(value).alias("largest"), F.stddev_samp(value).alias("std"), *tenth, *reach)


def seasonal_spread(weekly: DataFrame, value: str) -> DataFrame:
    """(week_of_year, mean, std) of a weekly value."""
    return weekly.groupBy(F.weekofyear("week_start").alias("week_of_year")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def unfixed_by_bundle(panel: DataFrame, members: DataFrame, dh_from: int) -> DataFrame:
    """(bundle_id, week_start, total, unfixed, unfixed_rate, is_dh) of the segments with reports."""
    rows = panel.where("y = 1").join(members.select(F.col("segment_id").alias("unit"), "bundle_id").where("bundle_id is not null"), "unit")
    out = rows.groupBy("bundle_id", "week_start").agg(F.count("*").alias("total"), F.count_if(F.col("r") == 0).alias("unfixed"))
    return out.withColumn("unfixed_rate", F.col("unfixed") / F.col("total")).withColumn("is_dh", F.col("bundle_id") >= dh_from)


def weekly_supply(unfixed: DataFrame) -> DataFrame:
    """(week_start, bundles, with_unfixed, dh_with_unfixed)."""
    some = F.col("unfixed") > 0
    return unfixed.groupBy("week_start").agg(F.count("*").alias("bundles"), F.count_if(some).alias("with_unfixed"), F.count_if(some & F.col("is_dh")).alias("dh_with_unfixed"))


def fix_timing(activities: DataFrame) -> DataFrame:
    """(week_of_year, n, contaminated, mean_days): share of reports closed before the next week's survey, and mean days to the closing, by ISO week."""
    early = F.coalesce(F.col("closed") < F.date_add("week_start", 7).cast("timestamp"), F.lit(False))
    days = (F.unix_micros(F.col("closed").cast("timestamp")) - F.unix_micros(F.col("reported").cast("timestamp"))) / F.lit(86_400_000_000.0)
    return activities.groupBy(F.weekofyear("week_start").alias("week_of_year")).agg(F.count("*").alias("n"), F.avg(early.cast("int")).alias("contaminated"), F.avg(days).alias("mean_days"))


def exposure(surveyed: DataFrame, panel: DataFrame) -> DataFrame:
    """(bundle_id, segments, potholes, fixed, treatment, control) of surveyed (segment_id, bundle_id, survey_week); weeks outside the panel count 0."""
    rows = surveyed.join(panel.select(F.col("unit").alias("segment_id"), F.col("week_start").alias("survey_week"), "y", "r"), ["segment_id", "survey_week"], "left")
    hit, fixed = F.coalesce("y", F.lit(0)), F.coalesce("r", F.lit(0))
    return rows.groupBy("bundle_id").agg(
        F.count("*").alias("segments"), F.sum(hit).alias("potholes"), F.sum(fixed).alias("fixed"), F.sum(F.when((hit == 1) & (fixed == 1), 1).otherwise(0)).alias("treatment"), F.sum(F.when((hit == 1) & (fixed == 0), 1).otherwise(0)).alias("control")
    )


def scenario_summary(near: DataFrame, lines: DataFrame, buffers: list[float], minima: list[int], key: str = "segment_id") -> DataFrame:
    """(scenario, n_segments, sum_addresses, median_length, median_density) for each pair of a buffer and a least count.

    ``near`` (addr, segment, dist) is the nearest join at the largest buffer; ``lines`` has each segment's length. All scenarios come from one pass.
    """
    counts = near.groupBy(key).agg(*(F.count_if(F.col("dist") <= b).alias(f"n{i}") for i, b in enumerate(buffers)))
    grid = F.explode(F.array(*[F.struct(F.lit(f"b{b:g}_m{m}").alias("scenario"), F.col(f"n{i}").alias("n"), F.lit(m).alias("least")) for i, b in enumerate(buffers) for m in minima]))
    # A table of all segments is small as Parquet, but not as rows in the driver.
    rows = counts.join(lines.select(key, "length").hint("merge"), key).select("length", grid.alias("g")).select("length", "g.*").where("n >= least")
    return rows.groupBy("scenario").agg(F.count("*").alias("n_segments"), F.sum("n").alias("sum_addresses"), F.median("length").alias("median_length"), F.median(density("n", "length")).alias("median_density"))


def density(count: str, length: str) -> Column:
    """Addresses per 100 m; null for a length of 0."""
    return F.expr(f"try_divide({count}, nullif({length}, 0)) * 100")
