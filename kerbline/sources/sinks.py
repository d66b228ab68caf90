"""Writers of plans, field packs and tables. Every writer goes through Spark's committers; a small report is one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.functions.text import map_link, person_key

PLAN_COLUMNS = ["date", "interviewer", "task", "bundle_id", "bundle_type", "list_code", "sfh_bundle_total"]


def write_table(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Parquet, partitioned by the named columns; only the partitions at hand are replaced."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str, *order: Column | str) -> None:
    """One CSV file with a header, in the stated order: for plans, summaries and packs of a day, whose rows are few by nature."""
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_plan(plan: DataFrame, path: str) -> None:
    """The plan in its fixed columns, sorted by task and interviewer."""
    write_report(plan.select(*PLAN_COLUMNS), path, "task", "interviewer", "list_code", "bundle_id")


def write_scenarios(eligible: DataFrame, mapping: DataFrame, summary: DataFrame, path: str) -> None:
    """Eligible segments by scenario, the address map, and the one-file summary."""
    write_table(eligible, f"{path}/eligible", "scenario")
    write_table(mapping, f"{path}/segment_addresses")
    write_report(summary, f"{path}/summary", "scenario")


def write_bundles(bundles: DataFrame, path: str) -> None:
    write_table(bundles, path)


def crosswalk(addresses: DataFrame) -> DataFrame:
    """(addr_id, segment_id): one segment of each address, the smallest."""
    return addresses.where("addr_id is not null").groupBy("addr_id").agg(F.min("segment_id").alias("segment_id"))


def write_crosswalk(addresses: DataFrame, path: str) -> None:
    write_report(crosswalk(addresses), path, "addr_id")


def features(lines: DataFrame, properties: list[str], zone: int | None = None) -> DataFrame:
    """(value): each line as one GeoJSON feature in degrees; ``zone`` tells the UTM zone of metre coordinates, None leaves coordinates as they are."""

    def point(p: Column) -> Column:
        if zone is None:
            return F.array(p["x"], p["y"])
        lat, lon = geo.utm_to_lat_lon(p["x"], p["y"], zone)
        return F.array(lon, lat)

    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("line", point).alias("coordinates"))
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_geojson(lines: DataFrame, properties: list[str], path: str, zone: int | None = None) -> None:
    """One feature per line, as readers of newline-delimited GeoJSON take it; map layers come from these files."""
    features(lines, properties, zone).write.mode("overwrite").text(path)


def starts(points: DataFrame, routes: DataFrame, date: str) -> DataFrame:
    """(date, interviewer, task, segment_id, n_sfh_targets, address): each routed segment with its targets and the address nearest to its first vertex.

    ``points`` are the addresses before any is dropped by its arm: (interviewer, task, segment_id, addr_id, address, x, y, sx, sy, dh_selected).
    """
    near = F.min(F.struct(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")).alias("d"), F.col("addr_id"), F.col("address")))
    kept = F.count_if((F.upper("task") != "DH") | F.coalesce("dh_selected", F.lit(False)))
    found = points.groupBy("interviewer", "task", "segment_id").agg(near.alias("b"), kept.alias("n"))
    steps = routes.select("interviewer", "task", "segment_id").distinct().join(found, ["interviewer", "task", "segment_id"], "left")
    return steps.select(F.lit(date).cast("date").alias("date"), "interviewer", "task", "segment_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_sfh_targets"), F.col("b.address").alias("address"))


def write_field_pack(routes: DataFrame, lines: DataFrame, points: DataFrame, starting: DataFrame, analysis: DataFrame, path: str, zone: int = 11, archive: str | None = None) -> None:
    """The day's pack: routes, segments, addresses, starting points and the segment analysis, the last also in the archive."""
    write_report(routes, f"{path}/routes", "interviewer", "task", "bundle_id", "seq")
    write_geojson(lines, [c for c in lines.columns if c != "line"], f"{path}/segments", zone)
    write_report(points.select("interviewer", "task", "segment_id", "lat", "lon", "addr_id", "address"), f"{path}/sfh_points", "interviewer", "task", "segment_id", "addr_id")
    write_report(starting, f"{path}/starts", "interviewer", "task", "segment_id")
    for target in (f"{path}/segment_analysis", archive):
        if target:
            write_report(analysis, target, "segment_id", "treatment_status_dh")


def messages(roster: DataFrame, mails: DataFrame, starting: DataFrame) -> DataFrame:
    """(name, email, task, segment_id, link, body): one message per rostered person and task with the task's first start; without an address none is made."""
    first = F.min(F.struct("segment_id", "address")).alias("b")
    tasks = starting.where("address is not null and address != ''").groupBy("interviewer", "task").agg(first)
    people = roster.withColumn("_key", person_key(F.col("name"))).join(mails.select(person_key(F.col("name")).alias("_key"), "email"), "_key").drop("_key")
    rows = people.join(tasks, F.col("slot") == F.col("interviewer"))
    link = map_link(F.col("b.address"))
    body = F.concat(F.lit("Hello "), F.col("name"), F.lit(", your "), F.col("task"), F.lit(" route starts at "), F.col("b.address"), F.lit(": "), link)
    return rows.select("name", "email", "task", F.col("b.segment_id").alias("segment_id"), link.alias("link"), body.alias("body"))


def write_simulation(results: dict[str, DataFrame], path: str) -> None:
    """Plan, stats, overlap and balance of a simulation as one CSV each."""
    for name, rows in results.items():
        write_report(rows, f"{path}/{name}", *[c for c in ("week", "category", "comparison", "variable", "bundle_id") if c in rows.columns])


def write_model(panel: DataFrame, unit_effects: DataFrame, week_effects: DataFrame, summary: DataFrame, path: str) -> None:
    """The fitted panel by year and the effects as tables."""
    write_table(panel.withColumn("year", F.year("week_start")), f"{path}/panel", "year")
    write_table(unit_effects, f"{path}/unit_effects")
    write_table(week_effects, f"{path}/week_effects")
    write_report(summary, f"{path}/summary", "week_start")


def map_page(layers: dict[str, DataFrame], title: str) -> DataFrame:
    """(value): one HTML page that draws each layer's lines (line, label) as a group of SVG paths with their labels as tooltips.

    For the layers of a day or a bundle sheet, whose lines fit one page; larger layers belong into GeoJSON files.
    """
    colours = ["#1b6ca8", "#b5482f", "#3f7d4e", "#7a5195", "#8a6d3b"]
    parts = None
    for at, (name, lines) in enumerate(layers.items()):
        steps = F.array_join(F.transform("line", lambda p: F.concat_ws(",", F.round(p["x"], 2).cast("string"), F.round(-p["y"], 2).cast("string"))), " L")
        label = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("label").cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;")
        path = F.concat(F.lit('<path d="M'), steps, F.lit('"><title>'), label, F.lit("</title></path>"))
        b = geo.bounds(F.col("line"))
        one = lines.where(F.size("line") > 1).select(path.alias("path"), b.alias("b")).agg(
            F.concat(F.lit(f'<g id="{name}" fill="none" stroke="{colours[at % len(colours)]}" vector-effect="non-scaling-stroke">'), F.array_join(F.sort_array(F.collect_list("path")), ""), F.lit("</g>")).alias("g"),
            F.min("b.x0").alias("x0"), F.min(-F.col("b.y1")).alias("y0"), F.max("b.x1").alias("x1"), F.max(-F.col("b.y0")).alias("y1"), F.lit(at).alias("at"),
        )
        parts = one if parts is None else parts.union(one)
    whole = parts.agg(F.sort_array(F.collect_list(F.struct("at", "g"))).alias("gs"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    box = F.concat_ws(" ", "x0", "y0", (F.col("x1") - F.col("x0")).cast("string"), (F.col("y1") - F.col("y0")).cast("string"))
    body = F.array_join(F.transform("gs", lambda s: s["g"]), "")
    return whole.select(F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><svg viewBox="'), F.coalesce(box, F.lit("0 0 1 1")), F.lit('" width="100%">'), body, F.lit("</svg></body></html>")).alias("value"))


def write_map(layers: dict[str, DataFrame], title: str, path: str) -> None:
    map_page(layers, title).coalesce(1).write.mode("overwrite").text(path)


def order_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """``df`` with the columns of ``first`` that it has in front, in that order, and all others after them."""
    lead = [c for c in first if c in df.columns]
    return df.select(*lead, *(c for c in df.columns if c not in lead))
