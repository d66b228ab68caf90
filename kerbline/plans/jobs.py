"""Jobs that chain the operators: sweep, bundle, plan, emit, simulate, doctor, crosswalk and the weekly run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import geo, text
from kerbline.functions.calendar import week_start
from kerbline.operators import assignment, balance, bundling, filters, history, panel, sampling, spatial
from kerbline.runtime import materialise, scratch
from kerbline.sources import sinks, tables


@dataclass(frozen=True)
class Plan:
    rows: DataFrame
    arms: DataFrame
    metadata: DataFrame


def sweep(addresses: DataFrame, streets: DataFrame, buffers: list[float], minima: list[int], zoning: DataFrame | None = None, codes: list[str] = (), mode: str = "include") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(eligible segments by scenario, address map, summary): addresses are filtered, matched to the nearest street of their name, and counted once for all scenarios."""
    kept = filters.addressable(addresses, "name", "number") if "number" in addresses.columns else addresses
    if zoning is not None:
        kept = filters.by_label(spatial.left_points_in_rings(kept, zoning, 300.0, "zone_name"), "zone_name", list(codes), mode).drop("zone_name").dropDuplicates(["addr_id"])
    match = text.names_match(text.street_key(F.col("name")), text.street_key(F.col("line_name")))
    near = materialise(spatial.nearest_line(kept, streets, max(buffers), match), "sweep")
    lengths = streets.select("segment_id", geo.length(F.col("line")).alias("length"))
    counts = near.groupBy("segment_id").agg(*(F.count_if(F.col("dist") <= b).alias(f"n{i}") for i, b in enumerate(buffers)))
    grid = F.explode(F.array(*[F.struct(F.lit(f"b{b:g}_m{m}").alias("scenario"), F.col(f"n{i}").alias("sfh_addr_count"), F.lit(m).alias("least")) for i, b in enumerate(buffers) for m in minima]))
    eligible = counts.select("segment_id", grid.alias("g")).select("segment_id", "g.*").where("sfh_addr_count >= least").drop("least").join(lengths, "segment_id")
    eligible = eligible.withColumn("addr_density_per_100m", panel.density("sfh_addr_count", "length"))
    return eligible, near.select("segment_id", "addr_id"), panel.scenario_summary(near, lengths, buffers, minima)


def bundle(segments: DataFrame, target: int = 120, method: str = "balanced", seed: int = 42, multiplier: float = 1.2, reach: float = 1.0) -> DataFrame:
    """Bundles of the segments (segment_id, line, n)."""
    return bundling.bundle_segments(bundling.component_table(segments, reach), target, method, seed, multiplier)


def plan(day: dt.date, activities: DataFrame, members: DataFrame, past: DataFrame, places: DataFrame, workers: DataFrame, seed: str | None = None) -> Plan:
    """The plan of a Saturday: eligible and unused bundles are drawn, segments get arms, and bundles go to workers.

    ``members`` has (segment_id, bundle_id, n), ``places`` (bundle_id, lat, lon, km), ``workers`` (name, lat, lon). On the first day of a phase only door
    hangers are drawn and each worker gets several bundles; later each worker gets one bundle of each task.
    """
    phase, first, last = filters.require_phase(day)
    seed = seed or f"{phase}|{day}"
    when = F.lit(day)
    known = history.between(past, F.lit(first), F.lit(last), when)
    used = history.used_bundles(known).where("dh").select("bundle_id")
    pool = members.where("bundle_id is not null").select("bundle_id").distinct()
    free = materialise(sampling.available(pool, used, pool.limit(0), "bundle_id"), "plan-free")
    by_week = materialise(history.eligible_weeks(activities, members), "plan-eligible")
    eligible = by_week.where(F.col("week_start") == when).select("bundle_id")
    first_day = known.isEmpty()
    dh = materialise(sampling.draw_dh(free.join(eligible, "bundle_id", "left_semi"), free, first_day, seed), "plan-dh").withColumn("task", F.lit("DH"))
    drawn = dh
    if not first_day:
        before = history.previous_plan(known, when).where(F.upper(F.trim("task")) == "DH")
        conditional = history.previous_conditional(known, when, by_week.withColumnRenamed("week_start", "date"))
        d2ds = sampling.draw_d2ds(conditional, before.select("bundle_id"), eligible, pool, seed)
        drawn = dh.unionByName(materialise(d2ds, "plan-d2ds").withColumn("task", F.lit("D2DS")))
    totals = members.groupBy("bundle_id").agg(F.sum("n").alias("sfh_bundle_total"))
    placed = drawn.join(places, "bundle_id", "left").withColumn("date", when)
    crew = workers.withColumn("date", when)
    # A bundle that is drawn for both tasks is assigned once for each.
    key = F.col("bundle_id") * 2 + (F.col("task") == "D2DS").cast("int")
    coded = placed.withColumn("code", key)
    method = "nearest_then_refine" if first_day else "joint_tasks"
    who = assignment.assign(coded.select("date", F.col("code").alias("bundle_id"), "lat", "lon", "km", "task"), crew, method).withColumnRenamed("bundle_id", "code")
    rows = coded.join(who.drop("date"), "code", "left").join(totals, "bundle_id", "left")
    rows = rows.select("date", F.col("name").alias("interviewer"), "task", "bundle_id", "bundle_type", "list_code", "sfh_bundle_total")
    rows = materialise(rows, "plan-rows")
    arms = sampling.arms(members.join(dh.select("bundle_id"), "bundle_id", "left_semi").select("bundle_id", "segment_id").distinct().withColumn("date", when), seed, "date", "bundle_id", "segment_id")
    metadata = rows.select("task", "bundle_id", "bundle_type").join(history.bundle_metadata(members, activities, when), "bundle_id")
    return Plan(rows, arms, metadata)


def emit(day: dt.date, planned: DataFrame, arms: DataFrame, table: DataFrame, segments: DataFrame, addresses: DataFrame, assigned: DataFrame, activities: DataFrame, path: str, zone: int = 11) -> dict[str, DataFrame]:
    """The day's field pack: walks of the planned bundles, addresses by arm, starting points and the segment analysis, written below ``path``.

    ``table`` is that of :func:`bundling.component_table` with bundle_id; ``assigned`` maps addresses to segments.
    """
    members = table.join(planned.select("bundle_id").distinct(), "bundle_id", "left_semi")
    walks = materialise(bundling.walks(members.select("segment_id", "bundle_id"), table.drop("bundle_id")), "emit-walks")
    routes = planned.select("date", "interviewer", "task", "bundle_id", "list_code").join(walks, "bundle_id")
    routes = materialise(routes.select("date", "interviewer", "task", "seq", "segment_id", "start_flag", "list_code", "bundle_id"), "emit-routes")
    steps = routes.select("interviewer", "task", "bundle_id", "segment_id").distinct()
    first = segments.select("segment_id", geo.first_point(F.col("line")).alias("p")).select("segment_id", F.col("p.x").alias("sx"), F.col("p.y").alias("sy"))
    points = tables.assigned_addresses(assigned, addresses, steps).join(steps, "segment_id").join(first, "segment_id", "left")
    points = points.join(arms.select("bundle_id", "segment_id", "dh_arm").distinct(), ["bundle_id", "segment_id"], "left")
    points = materialise(sampling.thin_segments(points, str(day)), "emit-points")
    starting = sinks.starts(points, routes, str(day))
    kept = filters.to_visit(points)
    lat, lon = geo.utm_to_lat_lon(F.col("x"), F.col("y"), zone)
    kept = kept.withColumn("lat", lat).withColumn("lon", lon)
    analysis = panel.segment_analysis(routes, activities, F.lit(day))
    zero = balance.zero_targets(routes, kept.groupBy("segment_id").agg(F.count("*").alias("n")))
    lines = segments.join(steps.select("segment_id", "bundle_id").distinct(), "segment_id").select("segment_id", "bundle_id", "line")
    sinks.write_field_pack(routes, lines, kept, starting, analysis, path, zone)
    return {"routes": routes, "points": kept, "starts": starting, "analysis": analysis, "zero_targets": zero}


def sampling_plan(weeks: list[dt.date], by_week: DataFrame, members: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """(plan, stats) of several weeks: door hangers without replacement, surveys from the previous week's, and running totals.

    The loop goes over weeks; each week's draw reads the pool and what was used, and is written before the next. A week's plan has at most 30 rows.
    """
    spark = members.sparkSession
    pool = materialise(members.where("bundle_id is not null").groupBy("bundle_id").agg(F.sum("n").alias("addresses")), "sim-pool")
    target = scratch(spark, "sim-plan")
    schema = "bundle_id bigint, bundle_type string, draw bigint, task string, week int, date date"
    plan_rows = spark.createDataFrame([], schema)
    for number, day in enumerate(weeks, 1):
        eligible = by_week.where(F.col("week_start") == F.lit(day)).select("bundle_id")
        used = plan_rows.where("task = 'DH'").select("bundle_id")
        free = pool.select("bundle_id").join(used, "bundle_id", "left_anti")
        dh = sampling.draw_dh(free.join(eligible, "bundle_id", "left_semi"), free, number == 1, f"{seed}|{day}").withColumn("task", F.lit("DH"))
        drawn = dh
        if number > 1:
            last = plan_rows.where((F.col("week") == number - 1) & (F.col("task") == "DH"))
            d2ds = sampling.draw_d2ds(last.where("bundle_type = 'conditional'").select("bundle_id"), last.select("bundle_id"), eligible, pool.select("bundle_id"), f"{seed}|{day}")
            drawn = dh.unionByName(d2ds.withColumn("task", F.lit("D2DS")))
        rows = drawn.select("bundle_id", "bundle_type", "draw", "task", F.lit(number).alias("week"), F.lit(day).alias("date"))
        rows.write.mode("append").parquet(target)
        plan_rows = spark.read.schema(schema).parquet(target)
    sums = plan_rows.join(pool, "bundle_id").groupBy("week", "date").agg(
        F.count_if(F.col("task") == "DH").alias("dh_bundles"), F.count_if(F.col("task") == "D2DS").alias("d2ds_bundles"), F.sum(F.when(F.col("task") == "DH", F.col("addresses")).otherwise(0)).alias("dh_addresses"),
        F.sum(F.when(F.col("task") == "D2DS", F.col("addresses")).otherwise(0)).alias("d2ds_addresses"), F.sum("addresses").alias("total_addresses"),
    )
    return plan_rows, panel.running(sums, "week", cumulative_dh="dh_addresses", cumulative_d2ds="d2ds_addresses", cumulative_total="total_addresses")


def simulate(weeks: list[dt.date], activities: DataFrame, members: DataFrame, covariates: list[str], seed: str = "42") -> dict[str, DataFrame]:
    """Plan, stats, overlap and balance of a simulated experiment over ``weeks``; ``members`` has the covariates of each segment."""
    by_week = materialise(history.eligible_weeks(activities, members), "sim-eligible")
    rows, stats = sampling_plan(weeks, by_week, members, seed)
    dh, d2ds = (rows.where(F.col("task") == t).select("bundle_id").distinct() for t in ("DH", "D2DS"))
    arms = sampling.arms(members.join(dh, "bundle_id", "left_semi").select("bundle_id", "segment_id").distinct(), seed, "bundle_id", "segment_id")
    overlap = balance.overlap(members, rows, "n")
    levels = balance.with_p(balance.all_levels(members, arms, dh, d2ds, covariates))
    return {"plan": rows, "stats": stats, "overlap": overlap, "balance": levels}


def doctor(layers: dict[str, DataFrame], events: DataFrame, unit: str, ts: str) -> DataFrame:
    """One row of counts, units and dates of the sources."""
    return history.diagnostics(layers, events, unit, ts)


def export_crosswalk(mapping: DataFrame, path: str) -> None:
    sinks.write_crosswalk(mapping, path)


def weekly(spark: SparkSession, today: dt.date, load: dict[str, DataFrame], path: str) -> Plan:
    """Plan and field pack of the next Saturday after ``today``, written below ``path``; ``load`` has the tables that :func:`plan` and :func:`emit` take."""
    day = spark.range(1).select(F.next_day(F.lit(today), "SAT")).first()[0]
    found = plan(day, load["activities"], load["members"], load["past"], load["places"], load["workers"])
    sinks.write_plan(found.rows, f"{path}/bundles_plan_{day}")
    sinks.write_report(found.arms, f"{path}/segment_assignments_{day}", "bundle_id", "segment_id")
    sinks.write_report(found.metadata, f"{path}/bundle_metadata_{day}", "task", "bundle_id")
    emit(day, found.rows, found.arms, load["table"], load["segments"], load["addresses"], load["assigned"], load["activities"], f"{path}/pack_{day}")
    return found


def reported_weeks(activities: DataFrame) -> DataFrame:
    """Activities with their Saturday week."""
    return activities.withColumn("week_start", week_start(F.col("reported")))
