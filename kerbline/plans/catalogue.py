"""Registered queries: each applies an operator to the test tables and states its SQL.

The event log stands for maintenance reports: user_id is the segment, an event is closed if its value is 100 or more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.calendar import previous_week, week_end, week_start
from kerbline.operators import balance, panel, ranking, sampling
from kerbline.plans import chain, networks, scalars, spatial_joins, statistics  # noqa: F401
from kerbline.plans.registry import QUERIES, SQL
from kerbline.plans.registry import query as _query
from kerbline.plans.registry import rounded as _rounded
from kerbline.plans.registry import table as _t

FLAGSHIP = "agg06_dense_panel"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


_WEEK = "(CAST(ts AS DATE) - CAST((dayofweek(ts) + 1) % 7 AS INTEGER))"
_CLOSED = "value >= 100"
_PANEL = f"""
    WITH seen AS (SELECT user_id AS unit, {_WEEK} AS week_start, count(*) AS n_events, min(CASE WHEN value >= 100 THEN 1 ELSE 0 END) AS r FROM events GROUP BY ALL),
    weeks AS (SELECT CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start FROM seen),
    panel AS (SELECT u.unit, w.week_start, coalesce(s.n_events, 0) AS n_events, CASE WHEN s.n_events IS NULL THEN 0 ELSE 1 END AS y, s.r
              FROM (SELECT DISTINCT unit FROM seen) u CROSS JOIN weeks w LEFT JOIN seen s ON s.unit = u.unit AND s.week_start = w.week_start)
"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense_panel(_t(spark, sf_dir, "events"), "user_id", "ts", F.expr(_CLOSED))


@_query(f"SELECT event_id, {_WEEK} AS week_start, {_WEEK} + 6 AS week_end, {_WEEK} - 7 AS previous_week FROM events")
def date01_survey_weeks(spark, sf_dir):
    ts = F.col("ts")
    return _t(spark, sf_dir, "events").select("event_id", week_start(ts).alias("week_start"), week_end(ts).alias("week_end"), previous_week(ts).alias("previous_week"))


@_query(f"SELECT user_id AS unit, {_WEEK} AS week_start, count(*) AS n_events FROM events GROUP BY ALL")
def agg01_weekly_counts(spark, sf_dir):
    return panel.weekly_counts(_t(spark, sf_dir, "events"), "user_id", "ts")


@_query("SELECT l_suppkey, sum(l_quantity) AS total, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def agg02_bundle_totals(spark, sf_dir):
    return balance.totals(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")


@_query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice, 2) AS others FROM orders")
def agg05_leave_one_out(spark, sf_dir):
    return panel.leave_one_out(_t(spark, sf_dir, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", F.round("others", 2).alias("others"))


@_query(_PANEL + "SELECT * FROM panel")
def agg06_dense_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


@_query("""
    WITH m AS (SELECT avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS m1, count(*) FILTER (c_mktsegment = 'BUILDING') AS n1, var_pop(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS p1, var_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS v1,
      avg(c_acctbal) FILTER (c_mktsegment <> 'BUILDING') AS m2, count(*) FILTER (c_mktsegment <> 'BUILDING') AS n2, var_pop(c_acctbal) FILTER (c_mktsegment <> 'BUILDING') AS p2, var_samp(c_acctbal) FILTER (c_mktsegment <> 'BUILDING') AS v2 FROM customer)
    SELECT round(m1, 4) AS group1_mean, n1 AS group1_n, round(m2, 4) AS group2_mean, n2 AS group2_n, round(m1 - m2, 4) AS difference, round(CASE WHEN p1 + p2 > 0 THEN (m1 - m2) / sqrt((p1 + p2) / 2) ELSE 0 END, 4) AS std_diff, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t_stat, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS dof FROM m
""")
def agg13_welch_balance(spark, sf_dir):
    out = balance.two_sample(_t(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING", "c_acctbal")
    return out.select("group1_n", "group2_n", *_rounded("group1_mean", "group2_mean", "difference", "std_diff", "t_stat", "dof"))


@_query(_PANEL + """, e AS (SELECT unit, week_start, avg(n_events) OVER (PARTITION BY unit) AS u, avg(n_events) OVER (PARTITION BY week_start) AS w, avg(n_events) OVER () AS g FROM panel)
    SELECT unit, week_start, round(u - g, 4) AS unit_effect, round(w - g, 4) AS week_effect, round(u + w - g, 4) AS fitted FROM e
""")
def agg24_two_way_effects(spark, sf_dir):
    return panel.count_effects(_t(spark, sf_dir, "events"), "user_id", "ts").select("unit", "week_start", *_rounded("unit_effect", "week_effect", "fitted"))


@_query(_PANEL + "SELECT week_start, sum(n_events)::BIGINT AS potholes, count(*) AS total_segments, round(avg(y), 4) AS pothole_rate, sum(coalesce(r, 0))::BIGINT AS fixed, round(sum(coalesce(r, 0)) / nullif(sum(y), 0), 4) AS fix_rate FROM panel GROUP BY 1")
def agg27_weekly_summary(spark, sf_dir):
    out = panel.weekly_summary(_panel(spark, sf_dir))
    return out.select("week_start", "potholes", "total_segments", "fixed", *_rounded("pothole_rate", "fix_rate"))


@_query(f"SELECT week_start, n, sum(n) OVER (ORDER BY week_start)::BIGINT AS cumulative FROM (SELECT {_WEEK} AS week_start, count(*) AS n FROM events GROUP BY 1)")
def agg33_cumulative_weeks(spark, sf_dir):
    weekly = _t(spark, sf_dir, "events").groupBy(week_start(F.col("ts")).alias("week_start")).agg(F.count("*").alias("n"))
    return panel.running(weekly, "week_start", cumulative="n")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def jon01_eligible_without_history(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    pool = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sampling.eligible(pool, orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority = '1-URGENT'"), "c_custkey")


@_query("SELECT c_mktsegment, c_custkey, draw::INTEGER AS draw FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42|' || c_custkey), c_custkey) AS draw FROM customer) WHERE draw <= 4")
def rnd01_seeded_draw(spark, sf_dir):
    return sampling.draw_per_group(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 4, "42").select("c_mktsegment", "c_custkey", "draw")


@_query(_PANEL + "SELECT unit, week_start, y, r, lag(y) OVER w AS y_lag, lag(r) OVER w AS r_lag FROM panel WINDOW w AS (PARTITION BY unit ORDER BY week_start)")
def win01_lagged_panel(spark, sf_dir):
    return ranking.lagged(_panel(spark, sf_dir).select("unit", "week_start", "y", "r"), "unit", "week_start", "y", "r")


@_query("SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS lowest, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS highest FROM orders GROUP BY 1")
def win02_extremes(spark, sf_dir):
    return ranking.extremes(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@_query("SELECT c_custkey, round(cume, 6) AS cume FROM (SELECT c_custkey, cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS cume FROM customer)")
def win04_empirical_cdf(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return panel.cumulative_share(rows, "c_mktsegment", "c_acctbal").select("c_custkey", F.round("cume", 6).alias("cume"))


@_query("""
    SELECT o_custkey, o_orderkey, fits FROM (SELECT *, o_orderstatus = 'F' AS fits FROM orders)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY fits DESC, o_totalprice, o_orderkey) = 1
""")
def win06_ranked_fallback(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return ranking.fallback(orders, "o_custkey", F.col("o_orderstatus") == "F", F.col("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "fits")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def srt02_top_k(spark, sf_dir):
    return ranking.top(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.col("o_orderkey"))


@_query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) = 1")
def set03_keep_first(spark, sf_dir):
    return ranking.first_per_group(_t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", F.col("o_orderkey"))
