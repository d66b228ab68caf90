"""Queries of the weekly planning chain: filters, history, draws and allocations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.operators import census, filters, history, ranking, sampling
from kerbline.operators.balance import rows_of
from kerbline.plans.registry import ACTIVITIES, ADDRESSES, BUNDLES, activities, addresses, bundles, query, table
from kerbline.plans.statistics import _PLAN, _eligible, _ELIGIBLE, plan_history


@query("""
    SELECT o_custkey::VARCHAR AS segment_id, CAST(o_orderdate AS DATE) AS reported, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 3 END AS closed, CAST(o_orderdate AS DATE) - CAST((dayofweek(o_orderdate) + 1) % 7 AS INTEGER) AS week_start
    FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AND o_custkey % 10 <> 0
""")
def flt01_patches(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "ASPHALT").otherwise("CONCRETE").alias("ACTIVITY_CODE_GROUP_TEXT"), F.when(k % 4 == 0, "OTHER").otherwise("POTHOLE PATCHED (EA)").alias("ACTIVITY_CODE_TEXT"),
        F.date_format(day, "M/d/y").alias("NOTIFICATION_DATE"), F.when(k % 2 == 0, F.date_format(F.date_add(day, 3), "yyyy-MM-dd")).otherwise("pending").alias("COMPLETION_DATE"),
        F.lit(None).cast("string").alias("CREATED_ON_DATE_FOR_ACTIVITY"), F.lit("").alias("END_DATE_FOR_ACTIVITY"),
        F.when(F.col("o_custkey") % 10 == 0, None).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("FUNCTIONAL_LOCATION"),
    )
    out = filters.patches(raw)
    return out.select("segment_id", F.to_date("date_reported").alias("reported"), F.to_date("date_closed").alias("closed"), "week_start")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-06' AND ts <= TIMESTAMP '2024-01-12'")
def flt02_closed_interval(spark, sf_dir):
    return filters.in_period(table(spark, sf_dir, "events"), "ts", F.lit(dt.date(2024, 1, 6)), F.lit(dt.date(2024, 1, 12))).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-13'")
def flt02_whole_last_day(spark, sf_dir):
    return filters.in_period(table(spark, sf_dir, "events"), "ts", F.lit(dt.date(2024, 1, 6)), F.lit(dt.date(2024, 1, 12)), inclusive_end=True).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def flt03_year_range(spark, sf_dir):
    return filters.in_years(table(spark, sf_dir, "orders"), "o_orderdate", 1996, 1998).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 NOT IN (0, 1, 2) AND c_custkey % 4 <> 0")
def flt04_addressable(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("num", F.when(k % 5 == 0, "0").when(k % 5 == 1, " 0000").when(k % 5 == 2, None).otherwise(k.cast("string"))).withColumn("street", F.when(k % 4 == 0, "  ").otherwise("Elm"))
    return filters.addressable(rows, "street", "num").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1")
def flt07_single_homes(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("unit", F.when(k % 3 == 0, " ").when(k % 3 == 1, "APT 2"))
    return filters.single_homes(rows, "unit").select("c_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) BETWEEN 8 AND 12")
def flt08_min_count(spark, sf_dir):
    return filters.at_least(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n", 8, 12)


@query(f"WITH {BUNDLES} SELECT bundle_id FROM bundles GROUP BY 1 HAVING count(*) FILTER (segment_id % 37 = 5) = 0")
def flt09_disjoint_bundles(spark, sf_dir):
    rows = bundles(spark, sf_dir)
    return filters.disjoint_groups(rows, rows.where("segment_id % 37 = 5"), "bundle_id", "segment_id")


@query(f"WITH {BUNDLES} SELECT bundle_id, sum(n_addresses)::BIGINT AS total, sum(n_addresses) BETWEEN 0.9 * 80 AND 1.1 * 80 AS kept FROM bundles GROUP BY 1")
def flt10_size_band(spark, sf_dir):
    return filters.size_band(bundles(spark, sf_dir), "bundle_id", "n_addresses", 80.0)


@query("""
    SELECT o_orderkey, CASE WHEN d BETWEEN DATE '2025-10-01' AND DATE '2026-01-03' THEN 'pilot' WHEN d BETWEEN DATE '2026-01-10' AND DATE '2026-12-31' THEN 'official' END AS phase
    FROM (SELECT o_orderkey, DATE '2025-09-25' + (o_orderkey % 150)::INTEGER AS d FROM orders)
""")
def flt11_phase_gate(spark, sf_dir):
    day = F.date_add(F.lit(dt.date(2025, 9, 25)), (F.col("o_orderkey") % 150).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", filters.phase(day).alias("phase"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def flt12_county(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("COUNTYA", F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))
    return filters.county(rows, "007").select("c_custkey")


def _points(spark, sf_dir):
    """Addresses of door hangers and surveys on segments with arms."""
    k = F.col("o_orderkey")
    arm = sampling.arms(bundles(spark, sf_dir).select("segment_id"), "3", "segment_id").select("segment_id", F.when(F.col("segment_id") % 10 != 0, F.col("dh_arm")).alias("dh_arm"))
    rows = table(spark, sf_dir, "orders").select(k.alias("addr_id"), F.col("o_custkey").alias("segment_id"), F.concat(F.lit("W"), (F.col("o_custkey") % 6).cast("string")).alias("interviewer"), F.when(k % 8 == 0, "D2DS").otherwise("DH").alias("task"))
    return rows.join(arm, "segment_id", "left")


_POINTS = f"""
    {BUNDLES}, pts AS (SELECT o_orderkey AS addr_id, o_custkey AS segment_id, 'W' || o_custkey % 6 AS interviewer, CASE WHEN o_orderkey % 8 = 0 THEN 'D2DS' ELSE 'DH' END AS task,
      CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN substr(sha256('3|' || o_custkey), 1, 8) < '40000000' THEN 'Full' WHEN substr(sha256('3|' || o_custkey), 1, 8) < '80000000' THEN 'Partial' ELSE 'Control' END AS dh_arm FROM orders),
    thin AS (SELECT *, CASE WHEN dh_arm IN ('Full', 'Partial') THEN lower(dh_arm) ELSE 'control' END AS dh_treatment, count(*) OVER w AS n, row_number() OVER (PARTITION BY interviewer, segment_id ORDER BY sha256('2026-03-14|' || interviewer || '|' || segment_id || '|DH|partial|' || addr_id), addr_id) AS k FROM pts WINDOW w AS (PARTITION BY interviewer, segment_id)),
    sel AS (SELECT *, CASE dh_treatment WHEN 'full' THEN true WHEN 'partial' THEN k <= n // 2 ELSE false END AS dh_selected FROM thin)
"""


@query(f"WITH {_POINTS} SELECT addr_id, dh_treatment, dh_selected FROM sel")
def smp05_thin_segments(spark, sf_dir):
    return sampling.thin_segments(_points(spark, sf_dir), "2026-03-14").select("addr_id", "dh_treatment", "dh_selected")


@query(f"WITH {_POINTS} SELECT addr_id FROM sel WHERE task <> 'DH' OR dh_selected")
def flt14_addresses_to_visit(spark, sf_dir):
    return filters.to_visit(sampling.thin_segments(_points(spark, sf_dir), "2026-03-14")).select("addr_id")


_ALLOCATED = """
    r AS (SELECT *, count(*) OVER (PARTITION BY {0}) AS n, row_number() OVER (PARTITION BY {0} ORDER BY sha256('2026-03-14|' || {1} || '|DH|treatment|' || addr_id), addr_id) AS k, substr(sha256('2026-03-14|' || {1} || '|DH|coin'), 1, 1) < '8' AS coin FROM p),
    a AS (SELECT *, CASE WHEN k <= 2 * (n // 4) THEN 'control' WHEN k <= 3 * (n // 4) THEN 'full' WHEN k <= 4 * (n // 4) THEN 'partial' WHEN k = 4 * (n // 4) + 1 THEN 'control' WHEN k = 4 * (n // 4) + 2 THEN CASE WHEN n % 4 = 2 THEN CASE WHEN coin THEN 'full' ELSE 'partial' END ELSE 'full' END ELSE 'partial' END AS dh_treatment FROM r),
    h AS (SELECT *, count(*) OVER (PARTITION BY {0}, dh_treatment) AS m, row_number() OVER (PARTITION BY {0}, dh_treatment ORDER BY sha256('2026-03-14|' || {1} || '|DH|partial|' || addr_id), addr_id) AS j FROM a)
    SELECT addr_id, dh_treatment, CASE dh_treatment WHEN 'full' THEN true WHEN 'partial' THEN j <= m // 2 ELSE false END AS dh_selected FROM h
"""


@query("WITH p AS (SELECT o_orderkey AS addr_id, 'W' || (o_custkey // 20) % 6 AS interviewer, o_custkey // 20 AS bundle_id FROM orders)," + _ALLOCATED.format("interviewer, bundle_id", "interviewer || '|' || bundle_id"))
def smp06_bundle_allocation(spark, sf_dir):
    group = F.floor(F.col("o_custkey") / 20)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("addr_id"), F.concat(F.lit("W"), (group % 6).cast("string")).alias("interviewer"), group.alias("bundle_id"))
    return sampling.allocate_bundles(rows, "2026-03-14", "interviewer", "bundle_id").select("addr_id", "dh_treatment", "dh_selected")


@query("WITH p AS (SELECT c_custkey AS addr_id, c_custkey // 20 AS bundle_id FROM customer)," + _ALLOCATED.format("bundle_id", "bundle_id"))
def smp07_segment_allocation(spark, sf_dir):
    rows = bundles(spark, sf_dir).select(F.col("segment_id").alias("addr_id"), "bundle_id")
    return sampling.allocate_bundles(rows, "2026-03-14", "bundle_id").select("addr_id", "dh_treatment", "dh_selected")


_POOL = f"{BUNDLES}, alls AS (SELECT DISTINCT bundle_id FROM bundles), elig AS (SELECT bundle_id FROM alls WHERE bundle_id % 9 = 4)"


def _draw_sql(elig: str, quota: int) -> str:
    return f"""
        WITH {_POOL}, c AS (SELECT bundle_id, row_number() OVER (ORDER BY sha256('42|conditional|' || bundle_id), bundle_id) AS draw FROM {elig} QUALIFY draw <= 4),
        r AS (SELECT bundle_id, row_number() OVER (ORDER BY sha256('42|random|' || bundle_id), bundle_id) AS draw FROM alls WHERE bundle_id NOT IN (SELECT bundle_id FROM c) QUALIFY draw <= {quota} - (SELECT count(*) FROM c))
        SELECT bundle_id, draw, 'conditional' AS bundle_type FROM c UNION ALL SELECT bundle_id, draw, 'random' FROM r
    """


@query(_draw_sql("elig", 24))
def smp01_first_day_draw(spark, sf_dir):
    alls = bundles(spark, sf_dir).select("bundle_id").distinct()
    return sampling.draw_dh(alls.where("bundle_id % 9 = 4"), alls, True, "42")


@query(_draw_sql("(SELECT bundle_id FROM alls WHERE bundle_id IN (5, 9))", 6))
def smp01_weekly_draw_short_pool(spark, sf_dir):
    alls = bundles(spark, sf_dir).select("bundle_id").distinct()
    return sampling.draw_dh(alls.where("bundle_id in (5, 9)"), alls, False, "42")


@query(f"""
    WITH {_POOL}, pc AS (SELECT bundle_id FROM alls WHERE bundle_id IN (3, 17)), pa AS (SELECT bundle_id FROM alls WHERE bundle_id IN (3, 17, 20)), e AS (SELECT bundle_id FROM alls WHERE bundle_id IN (17, 40)),
    h AS (SELECT bundle_id, row_number() OVER (ORDER BY p, o, bundle_id) AS draw FROM (SELECT bundle_id, 0 AS p, lpad(bundle_id::VARCHAR, 20, '0') AS o FROM pc UNION ALL SELECT bundle_id, 1, sha256('7|fill|' || bundle_id) FROM pa WHERE bundle_id NOT IN (SELECT bundle_id FROM pc)) QUALIFY draw <= 4),
    r AS (SELECT bundle_id, row_number() OVER (ORDER BY (bundle_id NOT IN (SELECT bundle_id FROM e)), sha256('7|random|' || bundle_id), bundle_id) AS draw FROM alls WHERE bundle_id NOT IN (SELECT bundle_id FROM h) QUALIFY draw <= 6 - (SELECT count(*) FROM h))
    SELECT bundle_id, 'd2ds_conditional' AS bundle_type, draw FROM h UNION ALL SELECT bundle_id, 'd2ds_random', draw FROM r
""")
def smp02_d2ds_fallbacks(spark, sf_dir):
    alls = bundles(spark, sf_dir).select("bundle_id").distinct()
    pick = lambda *ids: alls.where(F.col("bundle_id").isin(*ids))
    return sampling.draw_d2ds(pick(3, 17), pick(3, 17, 20), pick(17, 40), alls, "7")


@query("""
    SELECT c_custkey, CASE WHEN substr(sha256('7|' || c_custkey), 1, 8) < '40000000' THEN 'Full' WHEN substr(sha256('7|' || c_custkey), 1, 8) < '80000000' THEN 'Partial' ELSE 'Control' END AS dh_arm,
      CASE WHEN substr(sha256('7|' || c_custkey), 1, 8) < '40000000' THEN 1.0::DOUBLE WHEN substr(sha256('7|' || c_custkey), 1, 8) < '80000000' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS treated_share FROM customer
""")
def smp04_treatment_arms(spark, sf_dir):
    return sampling.arms(table(spark, sf_dir, "customer").select("c_custkey"), "7", "c_custkey")


@query("SELECT event_id, (('0x' || substr(sha256('42|' || event_id), 1, 8))::BIGINT / 4294967296.0 < least(1, value / 400))::INTEGER AS y_sim FROM events")
def smp08_bernoulli(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return sampling.bernoulli(rows, F.least(F.lit(1.0), F.col("value") / 400), "42", "event_id", name="y_sim").select("event_id", "y_sim")


@query("""
    WITH d AS (SELECT c_custkey AS bundle_id FROM customer ORDER BY sha256('42|day1|' || c_custkey), c_custkey LIMIT 30), p AS (SELECT bundle_id, row_number() OVER (ORDER BY bundle_id) - 1 AS k FROM d)
    SELECT bundle_id, substr('ABCDEF', (k // 5)::INTEGER + 1, 1) AS interviewer, (k % 5 + 1)::INTEGER AS list_code FROM p
""")
def smp09_day_one(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle_id"))
    return sampling.day_one(keys, "42", list("ABCDEF"))


@query(f"WITH {_POOL} SELECT bundle_id FROM alls WHERE bundle_id % 4 <> 1 OR bundle_id % 3 = 0")
def jon10_available_with_exemptions(spark, sf_dir):
    alls = bundles(spark, sf_dir).select("bundle_id").distinct()
    return sampling.available(alls, alls.where("bundle_id % 4 = 1"), alls.where("bundle_id % 3 = 0"), "bundle_id")


@query(f"WITH {_PLAN} SELECT bundle_id, bool_or(upper(trim(task)) = 'DH') AS dh, bool_or(upper(trim(task)) = 'D2DS') AS d2ds, min(date) AS first_date, count(DISTINCT date) AS n_dates FROM plan WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND date <> DATE '1997-03-01' GROUP BY 1")
def agg08_used_bundles(spark, sf_dir):
    day = lambda y, m, d: F.lit(dt.date(y, m, d))
    return history.used_bundles(history.between(plan_history(spark, sf_dir), day(1996, 1, 1), day(1999, 12, 31), day(1997, 3, 1)))


@query(f"WITH {_PLAN} SELECT date, upper(trim(task)) AS task, count(DISTINCT bundle_id) AS n_bundles, list_aggregate(list_sort(list(DISTINCT bundle_id)), 'string_agg', ',') AS bundles FROM plan GROUP BY 1, 2")
def agg08_usage_by_date(spark, sf_dir):
    return history.usage_by_date(plan_history(spark, sf_dir))


@query(f"WITH {_PLAN} SELECT o_orderkey, date, task, bundle_id FROM plan WHERE date = (SELECT max(date) FROM plan WHERE date < DATE '1998-06-06')")
def jon16_previous_plan(spark, sf_dir):
    return history.previous_plan(plan_history(spark, sf_dir), F.lit(dt.date(1998, 6, 6)))


@query(f"""
    WITH {_PLAN}, {_ELIGIBLE}, l AS (SELECT max(date) AS d FROM plan WHERE date < DATE '1997-11-15')
    SELECT DISTINCT p.bundle_id FROM plan p, l WHERE p.date = l.d AND upper(trim(task)) = 'DH' AND (p.date, p.bundle_id) IN (SELECT (week_start, bundle_id) FROM elig)
""".replace("(p.date, p.bundle_id) IN (SELECT (week_start, bundle_id) FROM elig)", "EXISTS (SELECT 1 FROM elig e WHERE e.week_start = p.date AND e.bundle_id = p.bundle_id)"))
def jon16_previous_conditional(spark, sf_dir):
    by_date = _eligible(spark, sf_dir).withColumnRenamed("week_start", "date")
    return history.previous_conditional(plan_history(spark, sf_dir), F.lit(dt.date(1997, 11, 15)), by_date)


@query(f"WITH {BUNDLES} SELECT bundle_id, n_addresses, o.o_orderkey FROM bundles JOIN orders o ON o_custkey = segment_id WHERE o_orderstatus = 'F'")
def jon08_inner_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("segment_id"), "o_orderkey")
    return bundles(spark, sf_dir).join(orders, "segment_id").select("bundle_id", "n_addresses", "o_orderkey")


@query(f"WITH {BUNDLES}, n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT segment_id, bundle_id, coalesce(n, 0) AS n FROM bundles LEFT JOIN n ON o_custkey = segment_id")
def jon07_counts_onto_segments(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("segment_id")).agg(F.count("*").alias("n"))
    return bundles(spark, sf_dir).join(counts, "segment_id", "left").select("segment_id", "bundle_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {BUNDLES} SELECT DISTINCT bundle_id FROM bundles WHERE segment_id IN (SELECT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-02-07' AND DATE '1998-02-13')")
def jon09_bundles_with_reports(spark, sf_dir):
    hits = filters.in_period(activities(spark, sf_dir), "reported", F.lit(dt.date(1998, 2, 7)), F.lit(dt.date(1998, 2, 13)), inclusive_end=True)
    return bundles(spark, sf_dir).join(hits.select("segment_id").distinct(), "segment_id", "left_semi").select("bundle_id").distinct()


@query("SELECT o_custkey AS segment_id, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS last_priority FROM orders GROUP BY 1")
def jon12_last_duplicate_wins(spark, sf_dir):
    out = history.last_wins(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderdate")
    return out.select(F.col("o_custkey").alias("segment_id"), F.col("o_orderpriority").alias("last_priority"))


@query(f"WITH {ADDRESSES}, r AS (SELECT DISTINCT o_custkey // 3 AS segment_id, o_orderpriority AS task FROM orders) SELECT addr_id, r.task FROM addresses LEFT JOIN r ON r.segment_id = addr_id // 3")
def jon18_fan_out(spark, sf_dir):
    routes = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 3).alias("segment_id"), F.col("o_orderpriority").alias("task"))
    points = addresses(spark, sf_dir).select("addr_id", F.floor(F.col("addr_id") / 3).alias("segment_id"))
    return points.join(routes.distinct(), "segment_id", "left").select("addr_id", "task")


@query("SELECT c_custkey AS segment_id, n_name AS bg_name, r_name AS tract_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 3 LEFT JOIN region ON r_regionkey = c_custkey % 7")
def jon19_demographics(spark, sf_dir):
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment_id"), F.col("c_nationkey").cast("string").alias("GISJOIN_BG"), (F.col("c_custkey") % 7).cast("string").alias("GISJOIN_TRACT"))
    bg = table(spark, sf_dir, "nation").where("n_nationkey != 3").select(F.col("n_nationkey").cast("string").alias("GISJOIN"), F.col("n_name").alias("bg_name"))
    tract = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("GISJOIN"), F.col("r_name").alias("tract_name"))
    return census.attach(segments, bg, tract).select("segment_id", "bg_name", "tract_name")


@query("SELECT row_number() OVER (ORDER BY upper(trim(task)), bundle_id, o_orderkey) AS place, o_orderkey FROM (SELECT o_orderkey, o_custkey // 20 AS bundle_id, CASE o_orderkey % 3 WHEN 0 THEN 'dh' WHEN 1 THEN 'DH ' ELSE 'D2DS' END AS task FROM orders WHERE o_custkey % 6 = 0 AND o_orderkey % 40 < 3) ORDER BY 1 LIMIT 500")
def srt01_plan_order(spark, sf_dir):
    order = [F.upper(F.trim("task")), F.col("bundle_id"), F.col("o_orderkey")]
    first = ranking.top(plan_history(spark, sf_dir), 500, *order)
    return first.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"), "o_orderkey")


@query("SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders GROUP BY 1")
def srt03_first_row(spark, sf_dir):
    rows = ranking.first_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", F.col("o_orderdate"), F.col("o_orderkey"))
    return rows.select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, 'customer' AS kind, NULL::INTEGER AS size FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier', NULL FROM supplier UNION ALL SELECT p_partkey, NULL, 'part', p_size FROM part")
def set01_concat(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_size").alias("size"))
    return rows_of([c, s, p])


_SETS = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 = 0)"


def _sets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return rows.where("o_orderstatus = 'F' and k % 2 = 0"), rows.where("k % 3 = 0")


@query(f"WITH {_SETS} SELECT k FROM a EXCEPT SELECT k FROM b")
def set02_difference(spark, sf_dir):
    return ranking.difference(*_sets(spark, sf_dir), "k")


@query(f"WITH {_SETS} SELECT k FROM a INTERSECT SELECT k FROM b")
def set02_intersection(spark, sf_dir):
    return ranking.intersection(*_sets(spark, sf_dir), "k")


@query(f"WITH {_SETS} SELECT k FROM a UNION SELECT k FROM b")
def set02_union(spark, sf_dir):
    return ranking.either(*_sets(spark, sf_dir), "k")
