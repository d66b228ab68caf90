"""Readers of the planning data: layers, lists, plans, rosters and census files, with explicit schemas.

Paths may lie in any store that Spark reads; nothing here opens a file by itself but configuration, which stands beside the driver's code.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.functions.calendar import any_date
from kerbline.functions.text import clean, date_in_name
from kerbline.runtime import materialise

PLAN = "date date, interviewer string, task string, bundle_id bigint, bundle_type string, list_code int, sfh_bundle_total bigint"
ACTIVITIES = "ACTIVITY_CODE_GROUP_TEXT string, ACTIVITY_CODE_TEXT string, NOTIFICATION_DATE string, COMPLETION_DATE string, CREATED_ON_DATE_FOR_ACTIVITY string, END_DATE_FOR_ACTIVITY string, FUNCTIONAL_LOCATION string"
WORKERS = "name string, email string, address string, lat double, lon double"
SLOTS = "ABCDEF"


@dataclass(frozen=True)
class Settings:
    """Sources by alias and parameters by name."""

    sources: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)


def load_settings(sources: str | Path, params: str | Path) -> Settings:
    """Two configuration files, YAML where a YAML library is at hand, else JSON."""
    return Settings(*(_parse(Path(p).read_text(encoding="utf-8")) for p in (sources, params)))


def _parse(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def resolve(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate among the columns, whatever its case."""
    known = {c.lower(): c for c in columns}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)


def ensure_column(df: DataFrame, want: str, candidates: list[str], *order: str) -> DataFrame:
    """``df`` with a column ``want``: renamed from the first candidate, else numbered 1..n in the stated order.

    The numbering counts rows per range of the order and adds offsets, so no task sees all rows.
    """
    found = resolve(df.columns, [want, *candidates])
    return df.withColumnRenamed(found, want) if found else number_rows(df, want, *order)


def number_rows(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with dense numbers from 1 in the order of the columns ``order``, which should leave no ties."""
    placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    local = materialise(placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "numbered")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_part").withColumn(name, (F.col("_at") + F.col("_base")).cast("bigint")).drop("_part", "_at", "_base")


def bind_sources(spark: SparkSession, settings: Settings) -> dict[str, DataFrame]:
    """Streets and addresses under either of their aliases, with ``segment_id`` and ``addr_id`` as canonical keys."""
    out = {}
    for name, aliases, key, ids in (("streets", ("streets", "segments"), "segment_id", ["iamfloc", "segid", "objectid"]), ("addresses", ("addresses", "addrs"), "addr_id", ["objectid", "addrapn", "id"])):
        entry = next((settings.sources[a] for a in aliases if a in settings.sources), None)
        if entry is None:
            raise KeyError(f"no source for {name}")
        layer = read_layer(spark, entry)
        out[name] = ensure_column(layer, key, ids, *layer.columns[:1])
    return out


def read_layer(spark: SparkSession, entry: dict) -> DataFrame:
    """A vector layer: Parquet with ``line``, ``ring`` or ``x``/``y`` columns, or GeoJSON, by its path's ending; ``crs`` becomes a column where stated."""
    path = entry["path"]
    layer = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_geojson(spark, path, entry["properties"])
    crs = entry.get("crs_input") or entry.get("crs")
    return layer.withColumn("crs", F.lit(crs)) if crs else layer


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files with the stated ``properties`` (a DDL schema) and their geometry.

    Points give x and y, line strings ``line``, polygons ``ring`` (the outer one). Other geometries give nulls.
    """
    feature = f"struct<properties:struct<{', '.join(':'.join(p.split()[:2]) for p in properties.split(','))}>,geometry:string>"
    rows = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    g = rows.select("f.properties.*", F.col("f.geometry").alias("_g"))
    kind = F.get_json_object("_g", "$.type")
    part = F.get_json_object("_g", "$.coordinates")
    points = lambda text: F.transform(F.from_json(text, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    at = F.from_json(F.when(kind == "Point", part), "array<double>")
    line = points(F.when(kind == "LineString", part))
    ring = F.get(F.transform(F.from_json(F.when(kind == "Polygon", part), "array<array<array<double>>>"), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))), F.lit(0))
    return g.withColumn("x", at[0]).withColumn("y", at[1]).withColumn("line", line).withColumn("ring", ring).drop("_g")


def read_keys(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(column): distinct trimmed keys of a one-list CSV; a file of one column may name it otherwise."""
    rows = spark.read.csv(path, header=True)
    found = resolve(rows.columns, [column]) or (rows.columns[0] if len(rows.columns) == 1 else None)
    if found is None:
        raise ValueError(f"{path} has no column {column}")
    return rows.select(clean(F.col(found)).alias(column)).where(F.col(column) != "").distinct()


def read_optional(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None if its path doesn't exist."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass(frozen=True)
class FilterLayers:
    zoning: DataFrame | None
    districts: DataFrame | None
    mode: str
    codes: tuple[str, ...]
    excluded_districts: tuple[str, ...]


def load_filter_layers(spark: SparkSession, settings: Settings) -> FilterLayers:
    """The optional zoning and district layers with the filters' mode and codes."""
    layer = lambda name: read_optional(spark, lambda: read_layer(spark, settings.sources[name])) if name in settings.sources else None
    zoning, districts = settings.params.get("zoning", {}), settings.params.get("districts", {})
    return FilterLayers(layer("zoning"), layer("districts"), zoning.get("mode", "include"), tuple(zoning.get("codes", ())), tuple(districts.get("exclude", ())))


def read_cached(spark: SparkSession, cache: str, fetch: Callable[[], DataFrame] | None = None, refresh: bool = False) -> DataFrame:
    """The cached table, or what ``fetch`` gives, which is cached; if fetching fails the old cache serves, and without one the error stays.

    A new copy is written beside the old one and named by the time, and the latest is read, so a broken write leaves the cache as it was.
    """
    held = latest_table(spark, cache)
    if held is not None and not refresh:
        return held
    try:
        if fetch is None:
            raise FileNotFoundError(f"{cache} is empty and nothing fetches it")
        fetch().write.parquet(f"{cache}/copy={time.time_ns()}")
    except Exception:
        if held is None:
            raise
        return held
    return latest_table(spark, cache)


def latest_table(spark: SparkSession, cache: str) -> DataFrame | None:
    """The newest copy below ``cache``."""
    rows = read_optional(spark, lambda: spark.read.parquet(cache))
    if rows is None or "copy" not in rows.columns:
        return None
    newest = rows.agg(F.max("copy")).first()[0]
    return None if newest is None else rows.where(F.col("copy") == newest).drop("copy")


def latest_file(spark: SparkSession, path: str, pattern: str = "*.parquet") -> str | None:
    """Path of the file below ``path`` that was changed last; sizes and times only, no content is read."""
    files = read_optional(spark, lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime"))
    row = None if files is None else files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return row[0] if row else None


def read_bundles(spark: SparkSession, shared: str, by_task: str | None = None) -> DataFrame:
    """The bundle table of a task's own file if stated, else the shared one; keys are cast once."""
    rows = spark.read.parquet(by_task or shared)
    return rows.withColumn("segment_id", F.col("segment_id").cast("string")).withColumn("bundle_id", F.when(~F.isnan(F.col("bundle_id").cast("double")), F.col("bundle_id")).cast("bigint"))


def read_plans(spark: SparkSession, path: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Past plans of all CSV files below ``path`` with their date from the file's name, within [first, last].

    Each file has its own header: older layouts lack some columns, which are null. Files without a date in their name and rows that don't
    fit their header are left out.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "bundles_plan_*.csv").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    head = F.col("value").rlike("(?i)^date,")
    heads = lines.where(head).groupBy("file").agg(F.split(F.lower(F.min("value")), ",").alias("names"))
    rows = lines.where(~head & (F.trim("value") != "")).withColumn("values", F.split("value", ",")).join(heads, "file").where(F.size("values") == F.size("names"))
    cell = F.map_from_arrays("names", "values")
    fields = [f.split() for f in PLAN.split(", ")]
    text = lambda n: F.nullif(F.trim(F.try_element_at(cell, F.lit(n))), F.lit(""))
    out = rows.select(*((date_in_name(F.col("file")) if n == "date" else text(n).try_cast("double").cast(t) if t in ("bigint", "int") else text(n)).alias(n) for n, t in fields)).where("date is not null")
    if first is not None:
        out = out.where(F.col("date") >= first)
    return out if last is None else out.where(F.col("date") <= last)


def assigned_addresses(assignment: DataFrame, addresses: DataFrame, segments: DataFrame) -> DataFrame:
    """Addresses with the segment that was assigned to them before, for the plan's segments only."""
    return assignment.join(segments.select("segment_id").distinct(), "segment_id", "left_semi").join(addresses, "addr_id")


def pad_rows(spark: SparkSession, rows: list[list]) -> DataFrame:
    """A small sheet range as a table of strings: the first row names the columns, short rows are filled with nulls and long ones cut."""
    header = [str(h).strip() or f"column_{i}" for i, h in enumerate(rows[0])] if rows else []
    body = [tuple([None if v is None else str(v) for v in r[: len(header)]] + [None] * (len(header) - len(r))) for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{h}` string" for h in header) or "empty string")


def locate(workers: DataFrame, cache: DataFrame, geocode: Callable[[Column], Column] | None = None) -> DataFrame:
    """Workers with lat and lon: their own, else those of the cache (address, lat, lon) by lower-cased address, else what ``geocode`` makes of the address."""
    known = cache.select(F.lower(F.trim("address")).alias("_key"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).dropDuplicates(["_key"])
    rows = workers.withColumn("_key", F.lower(F.trim("address"))).join(known, "_key", "left")
    found = geocode(F.col("address")) if geocode else F.lit(None).cast("struct<lat:double,lon:double>")
    rows = rows.withColumn("_g", F.when(F.coalesce("lat", "_lat").isNull(), found))
    return rows.withColumn("lat", F.coalesce("lat", "_lat", F.col("_g")["lat"])).withColumn("lon", F.coalesce("lon", "_lon", F.col("_g")["lon"])).drop("_key", "_lat", "_lon", "_g")


def roster(days: DataFrame, workers: DataFrame, day: Column) -> DataFrame:
    """(slot, name, lat, lon) of the workers that the roster's row of a date names in its slots A to F; those without coordinates are left out.

    The date may be written in any usual way; of several rows the first in their text order counts.
    """
    rows = days.where(any_date(F.col("Date").cast("string")) == day)
    slots = [s for s in SLOTS if s in days.columns]
    one = rows.orderBy(*slots).limit(1).unpivot([], slots, "slot", "name").where(clean(F.col("name")) != "")
    located = workers.where("lat is not null and lon is not null").select(F.lower(F.trim("name")).alias("_key"), "lat", "lon")
    return one.withColumn("_key", F.lower(F.trim("name"))).join(F.broadcast(located), "_key").select("slot", F.trim("name").alias("name"), "lat", "lon")


def read_census(spark: SparkSession, path: str, key: str = "GISJOIN") -> DataFrame:
    """A census CSV without the row of descriptions below its header: real keys start with a G and a digit."""
    return spark.read.csv(path, header=True).where(F.col(key).rlike(r"^G\d"))


def read_segment_demographics(spark: SparkSession, path: str) -> DataFrame:
    """The table of segment covariates, which must exist, with its key as text."""
    rows = read_optional(spark, lambda: spark.read.parquet(path))
    if rows is None:
        raise FileNotFoundError(f"segment demographics are missing: {path}")
    return rows.withColumn("segment_id", F.col("segment_id").cast("string"))
