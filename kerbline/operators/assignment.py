"""Assignment of bundles to workers, one plan date per group; a date has tens of bundles and a handful of workers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import haversine_km
from kerbline.operators import solvers
from kerbline.operators.spatial import cost_matrix

_OUT = "date date, bundle_id bigint, name string, list_code int, route_km double"


def _crew(workers: DataFrame) -> DataFrame:
    """Workers with columns of their own, as both sides of an assignment may come from one table."""
    names = ["date", "name", "lat", "lon"]
    return workers.select(*names).toDF(*names)


def assign(bundles: DataFrame, workers: DataFrame, method: str = "nearest_then_refine", closed: bool = False) -> DataFrame:
    """(date, bundle_id, name, list_code, route_km) of bundles (date, bundle_id, lat, lon, km[, task]) and workers (date, name, lat, lon).

    ``list_code`` is the bundle's place in the worker's route, ``route_km`` the whole route's km. Workers and bundles without coordinates are
    left out; a date without workers gets none. If a method fails, the date's bundles are dealt out in turn.
    """
    solve = solvers.METHODS[method]
    closed = closed or method == "two_stage_routing"

    def run(jobs: pd.DataFrame, crew: pd.DataFrame) -> pd.DataFrame:
        jobs = jobs.dropna(subset=["lat", "lon"]).drop_duplicates("bundle_id").sort_values("bundle_id").reset_index(drop=True)
        crew = crew.dropna(subset=["lat", "lon"]).drop_duplicates("name").sort_values("name").reset_index(drop=True)
        if jobs.empty or crew.empty:
            return pd.DataFrame({"date": [], "bundle_id": [], "name": [], "list_code": [], "route_km": []})
        p = solvers.Problem(crew[["lat", "lon"]].to_numpy(), jobs[["lat", "lon"]].to_numpy(), jobs["km"].fillna(0).to_numpy(), task=jobs["task"].str.upper().tolist())
        try:
            who = solve(p)
        except (ValueError, IndexError, ArithmeticError):
            who = solvers.round_robin(p)
        rows = []
        for w in range(p.w):
            km, order = p.route(w, [j for j, x in enumerate(who) if x == w], closed)
            rows += [(jobs["date"][0], jobs["bundle_id"][j], crew["name"][w], at + 1, km) for at, j in enumerate(order)]
        return pd.DataFrame(rows, columns=["date", "bundle_id", "name", "list_code", "route_km"])

    task = F.col("task") if "task" in bundles.columns else F.lit("DH")
    left = bundles.select("date", F.col("bundle_id").cast("bigint").alias("bundle_id"), "lat", "lon", "km", task.alias("task"))
    return left.groupBy("date").cogroup(_crew(workers).groupBy("date")).applyInPandas(run, _OUT)


def compare_costs(bundles: DataFrame, workers: DataFrame, methods: list[str]) -> DataFrame:
    """(date, method, simplified, routed, longest): totals of the simplified cost and of the routes under each method."""

    def run(jobs: pd.DataFrame, crew: pd.DataFrame) -> pd.DataFrame:
        jobs, crew = jobs.sort_values("bundle_id"), crew.sort_values("name")
        p = solvers.Problem(crew[["lat", "lon"]].to_numpy(), jobs[["lat", "lon"]].to_numpy(), jobs["km"].to_numpy(), task=["DH"] * len(jobs))
        found = [(m, solvers.METHODS[m](p)) for m in methods]
        return pd.DataFrame([(jobs["date"].iloc[0], m, solvers.simplified_cost(p, who), solvers.routed_cost(p, who), float(p.loads(who).max())) for m, who in found], columns=["date", "method", "simplified", "routed", "longest"])

    left, right = bundles.where("lat is not null and lon is not null").groupBy("date"), _crew(workers.where("lat is not null and lon is not null")).groupBy("date")
    return left.cogroup(right).applyInPandas(run, "date date, method string, simplified double, routed double, longest double")


def nearest_worker(workers: DataFrame, bundles: DataFrame) -> DataFrame:
    """(bundle_id, name, km): each bundle's nearest worker, the first name on ties."""
    best = F.min(F.struct("km", "name")).alias("b")
    return cost_matrix(workers, bundles).groupBy("bundle_id").agg(best).select("bundle_id", F.col("b.name").alias("name"), F.col("b.km").alias("km"))


def deal_in_turn(bundles: DataFrame, workers: DataFrame) -> DataFrame:
    """(date, bundle_id, name): the fallback, each date's bundles by id to its workers by name in turn."""
    slots = _crew(workers).select("date", "name").distinct().withColumn("slot", F.row_number().over(Window.partitionBy("date").orderBy("name")) - 1)
    sizes = slots.groupBy("date").agg(F.count("*").alias("crew"))
    placed = bundles.select("date", "bundle_id").distinct().withColumn("at", F.row_number().over(Window.partitionBy("date").orderBy("bundle_id")) - 1)
    return placed.join(sizes, "date").withColumn("slot", F.col("at") % F.col("crew")).join(slots, ["date", "slot"]).select("date", "bundle_id", "name")


def cluster_spread(assigned: DataFrame) -> DataFrame:
    """(cluster, n, diameter, far_a, far_b): size, largest distance and the pair that has it, of (cluster, id, lat, lon).

    The self-join is within a cluster of at most a few bundles.
    """
    a = assigned.select("cluster", F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = assigned.select("cluster", F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = a.join(b, "cluster").where("a < b").withColumn("d", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    far = pairs.groupBy("cluster").agg(F.min(F.struct((-F.col("d")).alias("d"), "a", "b")).alias("m"))
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.join(far, "cluster", "left").select("cluster", "n", F.coalesce(-F.col("m.d"), F.lit(0.0)).alias("diameter"), F.col("m.a").alias("far_a"), F.col("m.b").alias("far_b"))
