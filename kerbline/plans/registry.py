"""Where queries register with their SQL, and the roles that the test tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.calendar import week_start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of (spark, sf_dir) with its DuckDB SQL; without SQL it is covered by property tests."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(*names: str, digits: int = 4) -> list:
    return [F.round(n, digits).alias(n) for n in names]


#: The Saturday on or before a timestamp, in SQL.
WEEK = "(CAST({0} AS DATE) - CAST((dayofweek({0}) + 1) % 7 AS INTEGER))"

#: Maintenance reports: an order is a report on the segment o_custkey, closed with its last shipment.
ACTIVITIES = """
    activities AS (SELECT o_custkey AS segment_id, o_orderkey AS report_id, o_orderdate AS reported, closed,
        CAST(o_orderdate AS DATE) - CAST((dayofweek(o_orderdate) + 1) % 7 AS INTEGER) AS week_start
      FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""
#: Segments in bundles of twenty: segment c_custkey lies in bundle c_custkey // 20 and has c_custkey % 9 addresses.
BUNDLES = "bundles AS (SELECT c_custkey AS segment_id, c_custkey // 20 AS bundle_id, c_custkey % 9 AS n_addresses, c_acctbal AS covariate FROM customer)"
#: Streets of two straight pieces, addresses and four-cornered zones in a square of 10 km.
STREETS = """
    streets AS (SELECT p_partkey AS segment_id, x1, y1, x2, y2, x2 + (p_partkey % 5) * 20.0 - 40 AS x3, y2 + (p_partkey % 3) * 25.0 - 25 AS y3,
        CASE p_partkey % 4 WHEN 0 THEN 'MAPLE ST' WHEN 1 THEN 'Oak Avenue' WHEN 2 THEN 'Pine Rd.' ELSE '' END AS name
      FROM (SELECT p_partkey, x1, y1, x1 + (p_partkey % 7) * 15.0 - 45 AS x2, y1 + (p_partkey % 11) * 12.0 - 60 AS y2
            FROM (SELECT p_partkey, ((p_partkey * 7919) % 10007)::DOUBLE AS x1, ((p_partkey * 104729) % 10009)::DOUBLE AS y1 FROM part)))
"""
ADDRESSES = """
    addresses AS (SELECT c_custkey AS addr_id, ((c_custkey * 6947) % 10007) + 0.25::DOUBLE AS x, ((c_custkey * 15485863) % 10009) + 0.5::DOUBLE AS y,
        CASE c_custkey % 3 WHEN 0 THEN 'Maple Street' WHEN 1 THEN 'OAK AVE' ELSE 'PINE ROAD, N.' END AS name FROM customer)
"""
ZONES = """
    zones AS (SELECT s_suppkey AS zone_id, 'Z' || (s_suppkey % 6) AS zone_name, cx - w AS ax, cy - w AS ay, cx + w AS bx, cy - w / 2 AS by_, cx + w / 2 AS gx, cy + w AS gy, cx - w AS hx, cy + w / 2 AS hy
      FROM (SELECT s_suppkey, ((s_suppkey * 3571) % 10007)::DOUBLE AS cx, ((s_suppkey * 7877) % 10009)::DOUBLE AS cy, 300.0 + (s_suppkey % 5) * 50 AS w FROM supplier))
"""


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("segment_id"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("reported"))
    return orders.join(closed, F.col("l_orderkey") == F.col("report_id"), "left").drop("l_orderkey").withColumn("week_start", week_start(F.col("reported")))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("segment_id"), F.floor(key / 20).alias("bundle_id"), (key % 9).alias("n_addresses"), F.col("c_acctbal").alias("covariate")
    )


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x1, y1 = (k * 7919 % 10007).cast("double"), (k * 104729 % 10009).cast("double")
    rows = table(spark, sf_dir, "part").select(k.alias("segment_id"), x1.alias("x1"), y1.alias("y1"))
    k = F.col("segment_id")
    rows = rows.withColumn("x2", F.col("x1") + k % 7 * 15.0 - 45).withColumn("y2", F.col("y1") + k % 11 * 12.0 - 60)
    x3, y3 = F.col("x2") + k % 5 * 20.0 - 40, F.col("y2") + k % 3 * 25.0 - 25
    line = F.array(_point(F.col("x1"), F.col("y1")), _point(F.col("x2"), F.col("y2")), _point(x3, y3))
    name = F.when(k % 4 == 0, "MAPLE ST").when(k % 4 == 1, "Oak Avenue").when(k % 4 == 2, "Pine Rd.").otherwise("")
    return rows.select("segment_id", line.alias("line"), name.alias("name"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "Maple Street").when(k % 3 == 1, "OAK AVE").otherwise("PINE ROAD, N.")
    return table(spark, sf_dir, "customer").select(k.alias("addr_id"), (k * 6947 % 10007 + 0.25).alias("x"), (k * 15485863 % 10009 + 0.5).alias("y"), name.alias("name"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cx, cy, w = (k * 3571 % 10007).cast("double"), (k * 7877 % 10009).cast("double"), 300.0 + k % 5 * 50
    ring = F.array(_point(cx - w, cy - w), _point(cx + w, cy - w / 2), _point(cx + w / 2, cy + w), _point(cx - w, cy + w / 2))
    return table(spark, sf_dir, "supplier").select(k.alias("zone_id"), F.concat(F.lit("Z"), (k % 6).cast("string")).alias("zone_name"), ring.alias("ring"))
