"""Queries of panels, balance, overlap and summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kerbline.functions.calendar import week_start
from kerbline.operators import balance, census, filters, history, panel, sampling
from kerbline.plans.registry import ACTIVITIES, BUNDLES, WEEK, activities, bundles, query, rounded, table

#: Reports of one year, a dense panel over them.
_YEAR = "acts AS (SELECT * FROM activities WHERE reported >= TIMESTAMP '1997-01-01' AND reported < TIMESTAMP '1998-01-01')"
_PANEL = f"""
    {ACTIVITIES}, {_YEAR}, seen AS (SELECT segment_id AS unit, week_start, count(*) AS n_events, min(coalesce(closed <= CAST(week_start + 6 AS TIMESTAMP), false)::INTEGER) AS r FROM acts GROUP BY ALL),
    weeks AS (SELECT CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start FROM seen),
    panel AS (SELECT u.unit, w.week_start, coalesce(s.n_events, 0) AS n_events, CASE WHEN s.n_events IS NULL THEN 0 ELSE 1 END AS y, s.r
              FROM (SELECT DISTINCT unit FROM seen) u CROSS JOIN weeks w LEFT JOIN seen s ON s.unit = u.unit AND s.week_start = w.week_start)
"""


def _year(spark, sf_dir):
    return filters.in_years(activities(spark, sf_dir), "reported", 1997, 1997)


def _report_panel(spark, sf_dir):
    return panel.report_panel(_year(spark, sf_dir))


@query(f"WITH {_PANEL} SELECT unit, week_start, n_events, y, r FROM panel WHERE y = 1 OR unit % 10 = 0")
def agg07_panel_closed_in_time(spark, sf_dir):
    return _report_panel(spark, sf_dir).where("y = 1 or unit % 10 = 0")


@query(f"""
    WITH {ACTIVITIES}, day AS (SELECT DATE '1998-02-14' AS d), routes AS (SELECT DISTINCT c_custkey AS segment_id, c_custkey // 20 AS bundle_id, CASE c_custkey % 2 WHEN 0 THEN 'DH' ELSE 'd2ds' END AS task FROM customer WHERE c_custkey % 3 = 0),
    m AS (SELECT segment_id, week_start, count(*) AS n, count(closed) AS f, avg(CAST(floor((epoch_us(closed) - epoch_us(reported)) / 86400000000.0) AS BIGINT)) AS a, max(CAST(floor((epoch_us(closed) - epoch_us(reported)) / 86400000000.0) AS BIGINT)) AS x FROM activities GROUP BY ALL),
    j AS (SELECT r.*, coalesce(t.n, 0) AS n1, coalesce(t.f = t.n, false)::INTEGER AS all1, coalesce(t.f / t.n, 0) AS s1, coalesce(t.a, 0) AS a1, coalesce(l.n, 0) AS n2, coalesce(l.x, 0) AS x2
      FROM routes r CROSS JOIN day LEFT JOIN m t ON t.segment_id = r.segment_id AND t.week_start = d LEFT JOIN m l ON l.segment_id = r.segment_id AND l.week_start = d - 7)
    SELECT segment_id, bundle_id, CASE WHEN task = 'DH' THEN 'DH' ELSE '' END AS treatment_status_dh, n1 AS pothole_count_this_week, all1 AS all_potholes_fixed_this_week, round(s1, 4) AS share_fixed_this_week, round(a1, 4) AS avg_days_to_fix_this_week,
      n2 AS pothole_count_last_week, x2 AS max_days_to_fix_last_week, (sum(n1) OVER (PARTITION BY bundle_id) - n1)::BIGINT AS bundle_pothole_count_excl_segment FROM j
""")
def agg04_segment_analysis(spark, sf_dir):
    k = F.col("c_custkey")
    task = F.when(k % 2 == 0, "DH").otherwise("d2ds")
    day = F.lit(dt.date(1998, 2, 14))
    routes = table(spark, sf_dir, "customer").where(k % 3 == 0).select(k.alias("segment_id"), F.floor(k / 20).alias("bundle_id"), task.alias("task"), day.alias("date"))
    out = panel.segment_analysis(routes, activities(spark, sf_dir), day)
    return out.select(
        "segment_id", "bundle_id", "treatment_status_dh", "pothole_count_this_week", "all_potholes_fixed_this_week", *rounded("share_fixed_this_week", "avg_days_to_fix_this_week"),
        "pothole_count_last_week", "max_days_to_fix_last_week", "bundle_pothole_count_excl_segment",
    )


@query(f"WITH {BUNDLES} SELECT bundle_id, count(*) AS n, list_aggregate(list_sort(list(DISTINCT segment_id)), 'string_agg', ',') AS segments FROM bundles GROUP BY 1")
def agg09_segment_lists(spark, sf_dir):
    return history.segment_lists(bundles(spark, sf_dir)).select("bundle_id", "n", F.array_join("segments", ",").alias("segments"))


@query(f"""
    WITH {ACTIVITIES}, {BUNDLES}, hit AS (SELECT segment_id, count(*) AS n FROM activities WHERE week_start = DATE '1998-02-07' GROUP BY 1)
    SELECT bundle_id, count(DISTINCT segment_id) AS num_segments, coalesce(sum(h.n), 0)::BIGINT AS num_potholes_in_preceding_week, coalesce(string_agg(CASE WHEN h.n IS NOT NULL THEN segment_id::VARCHAR END, ',' ORDER BY segment_id::VARCHAR), '') AS segments_with_potholes
    FROM bundles LEFT JOIN hit h USING (segment_id) GROUP BY 1
""")
def agg10_bundle_metadata(spark, sf_dir):
    return history.bundle_metadata(bundles(spark, sf_dir), activities(spark, sf_dir), F.lit(dt.date(1998, 2, 14)))


_SIZES = "b AS (SELECT l_suppkey // 2 AS bundle_id, sum(l_quantity) AS size, count(DISTINCT l_partkey % 3) AS segments FROM lineitem WHERE l_suppkey % 7 <> 0 OR l_partkey % 2 = 0 GROUP BY 1)"


def _sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 0 or l_partkey % 2 = 0")
    return rows.groupBy(F.floor(F.col("l_suppkey") / 2).alias("bundle_id")).agg(F.sum("l_quantity").alias("size"), F.count_distinct(F.col("l_partkey") % 3).alias("segments"))


@query(f"""
    WITH {_SIZES}, m AS (SELECT count(*) AS n, sum(size) AS total, avg(size) AS mean, median(size) AS med, stddev_pop(size) AS std, min(size) AS lo, max(size) AS hi, quantile_cont(size, 0.25) AS p25, quantile_cont(size, 0.75) AS p75, count(*) FILTER (segments = 1) AS single, avg(segments) AS ms FROM b),
    d AS (SELECT avg(abs(size - mean)) AS mad, count(*) FILTER (size < p25 - 1.5 * (p75 - p25) OR size > p75 + 1.5 * (p75 - p25)) AS outl FROM b, m)
    SELECT n AS n_bundles, round(total, 2) AS total, round(mean, 4) AS mean, round(med, 4) AS median, round(std, 4) AS std, lo AS smallest, hi AS largest, round(p25, 4) AS p25, round(p75, 4) AS p75, round(std / mean, 6) AS cv, round(mad / mean, 6) AS masd, hi - lo AS range, round(hi / nullif(lo, 0), 6) AS ratio,
      round(p75 - p25, 4) AS iqr, outl AS n_outliers, round(outl / n, 6) AS outlier_share, single AS n_singletons, round(single / n, 6) AS singleton_share, round(ms, 4) AS mean_segments FROM m, d
""")
def agg11_size_measures(spark, sf_dir):
    out = balance.size_metrics(_sizes(spark, sf_dir), "size", "segments")
    return out.select("n_bundles", "smallest", "largest", "range", "n_outliers", "n_singletons", F.round("total", 2).alias("total"), *rounded("mean", "median", "std", "p25", "p75", "iqr", "mean_segments"), *rounded("cv", "masd", "ratio", "outlier_share", "singleton_share", digits=6))


@query(f"""
    WITH {_SIZES} SELECT count(*) AS n_bundles, count(*) FILTER (size > 37000) AS violations, max(size) AS largest, round(max(abs(size - 30900.0)), 4) AS max_deviation, round(avg(abs(size - 30900.0)), 4) AS mean_deviation, 37080 AS hard_max,
      count(*) FILTER (size BETWEEN 0.9 * 30900.0 AND 1.1 * 30900.0) AS n_in_band, round(count(*) FILTER (size > 37080) / count(*), 6) AS violation_share FROM b
""".replace("size > 37000", "size > 37080"))
def agg12_hard_limit(spark, sf_dir):
    out = balance.hard_limit_metrics(_sizes(spark, sf_dir), "size", 30900.0, 1.2)
    return out.select("n_bundles", "violations", "largest", "hard_max", "n_in_band", *rounded("max_deviation", "mean_deviation"), F.round("violation_share", 6).alias("violation_share"))


@query(f"""
    WITH {_SIZES}, m AS (SELECT count(*) AS n, avg(size) AS mean, stddev_pop(size) AS std, min(size) AS lo, max(size) AS hi, count(*) FILTER (segments = 1) AS single FROM b), d AS (SELECT avg(abs(size - mean)) / any_value(mean) AS masd FROM b, m)
    SELECT CASE WHEN std / mean < 0.1 THEN 'excellent' WHEN std / mean < 0.15 THEN 'good' WHEN std / mean < 0.2 THEN 'acceptable' WHEN std / mean < 0.3 THEN 'fair' ELSE 'poor' END AS cv_label,
      CASE WHEN masd < 0.1 THEN 'excellent' WHEN masd < 0.15 THEN 'good' WHEN masd < 0.2 THEN 'acceptable' ELSE 'poor' END AS masd_label,
      CASE WHEN single / n < 0.02 THEN 'excellent' WHEN single / n < 0.05 THEN 'good' WHEN single / n < 0.1 THEN 'acceptable' ELSE 'poor' END AS singleton_label, std / mean > 0.25 OR hi / lo > 3 AS rebalance FROM m, d
""")
def agg37_quality_labels(spark, sf_dir):
    return balance.quality_report(balance.size_metrics(_sizes(spark, sf_dir), "size", "segments")).select("cv_label", "masd_label", "singleton_label", "rebalance")


_SEG = "seg AS (SELECT c_custkey AS segment_id, c_custkey // 20 AS bundle_id, c_acctbal AS v1, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 97)::DOUBLE END AS v2, 5.0 AS v3 FROM customer)"
_ARM = "arm AS (SELECT segment_id, CASE WHEN substr(sha256('7|' || segment_id), 1, 8) < '40000000' THEN 'Full' WHEN substr(sha256('7|' || segment_id), 1, 8) < '80000000' THEN 'Partial' ELSE 'Control' END AS dh_arm FROM seg WHERE bundle_id % 3 <> 0)"
_STATS = """
    SELECT variable, round(avg(v) FILTER (g), 4) AS group1_mean, count(v) FILTER (g) AS group1_n, round(avg(v) FILTER (NOT g), 4) AS group2_mean, count(v) FILTER (NOT g) AS group2_n, round(avg(v) FILTER (g) - avg(v) FILTER (NOT g), 4) AS difference,
      round(CASE WHEN var_pop(v) FILTER (g) + var_pop(v) FILTER (NOT g) > 0 THEN (avg(v) FILTER (g) - avg(v) FILTER (NOT g)) / sqrt((var_pop(v) FILTER (g) + var_pop(v) FILTER (NOT g)) / 2) ELSE 0 END, 4) AS std_diff,
      round((avg(v) FILTER (g) - avg(v) FILTER (NOT g)) / nullif(sqrt(var_samp(v) FILTER (g) / count(v) FILTER (g) + var_samp(v) FILTER (NOT g) / count(v) FILTER (NOT g)), 0), 4) AS t_stat, {0} AS comparison
    FROM (SELECT {1} AS g, unnest(['v1', 'v2', 'v3']) AS variable, unnest([v1, v2, v3]) AS v FROM {2}) GROUP BY variable
"""


def _segments(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("segment_id"), F.floor(k / 20).alias("bundle_id"), F.col("c_acctbal").alias("v1"), F.when(k % 11 == 0, None).otherwise((k % 97).cast("double")).alias("v2"), F.lit(5.0).alias("v3"))


def _assigned(spark, sf_dir):
    return sampling.arms(_segments(spark, sf_dir).where("bundle_id % 3 != 0").select("segment_id"), "7", "segment_id")


_LEVELS = " UNION ALL ".join([
    _STATS.format("'treatment_vs_control'", "dh_arm IN ('Full', 'Partial')", "seg JOIN arm USING (segment_id)"),
    _STATS.format("'survey_sample'", "dh_arm IN ('Full', 'Partial')", "seg JOIN arm USING (segment_id) WHERE bundle_id % 3 <> 0 AND bundle_id % 2 = 0"),
    _STATS.format("'survey_representativeness'", "bundle_id % 2 = 0", "seg WHERE bundle_id % 3 <> 0 OR bundle_id % 2 = 0"),
])


@query(f"WITH {_SEG}, {_ARM} {_LEVELS}")
def agg17_balance_levels(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    dh, d2ds = seg.where("bundle_id % 3 != 0").select("bundle_id").distinct(), seg.where("bundle_id % 2 = 0").select("bundle_id").distinct()
    out = balance.all_levels(seg, _assigned(spark, sf_dir), dh, d2ds, ["v1", "v2", "v3"])
    return out.select("comparison", "variable", "group1_n", "group2_n", *rounded("group1_mean", "group2_mean", "difference", "std_diff", "t_stat"))


def _level(name: str, sql: str):
    def run(spark, sf_dir):
        return agg17_balance_levels(spark, sf_dir).where(F.col("comparison") == name)

    return query(f"WITH {_SEG}, {_ARM} SELECT * FROM ({_LEVELS}) WHERE comparison = '{name}'")(_named(run, sql))


def _named(f, name):
    f.__name__ = name
    return f


_level("treatment_vs_control", "agg14_treated_against_control")
_level("survey_sample", "agg15_treated_in_survey")
_level("survey_representativeness", "agg16_surveyed_against_rest")


_PLAN = "plan AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST((dayofweek(o_orderdate) + 1) % 7 AS INTEGER) AS date, CASE o_orderkey % 3 WHEN 0 THEN 'dh' WHEN 1 THEN 'DH ' ELSE 'D2DS' END AS task, o_custkey // 20 AS bundle_id FROM orders WHERE o_custkey % 6 = 0 AND o_orderkey % 40 < 3)"


def plan_history(spark, sf_dir):
    k = F.col("o_orderkey")
    task = F.when(k % 3 == 0, "dh").when(k % 3 == 1, "DH ").otherwise("D2DS")
    rows = table(spark, sf_dir, "orders").where("o_custkey % 6 = 0 and o_orderkey % 40 < 3")
    return rows.select(k, week_start(F.col("o_orderdate")).alias("date"), task.alias("task"), F.floor(F.col("o_custkey") / 20).alias("bundle_id"))


@query(f"""
    WITH {BUNDLES}, {_PLAN}, u AS (SELECT bundle_id, bool_or(upper(trim(task)) = 'DH') AS dh, bool_or(upper(trim(task)) = 'D2DS') AS d2 FROM plan GROUP BY 1),
    p AS (SELECT bundle_id, count(DISTINCT segment_id) AS s, sum(n_addresses) AS a FROM bundles GROUP BY 1),
    k AS (SELECT CASE WHEN dh AND d2 THEN 'Both DH & D2DS' WHEN dh THEN 'DH only' WHEN d2 THEN 'D2DS only' ELSE 'Never used' END AS category, coalesce(dh OR d2, false) AS used, s, a FROM p LEFT JOIN u USING (bundle_id)),
    c AS (SELECT category, count(*) AS b, sum(s) AS s, sum(a) AS a FROM k GROUP BY 1 UNION ALL SELECT 'Total (used)', count(*), sum(s), sum(a) FROM k WHERE used), w AS (SELECT count(*) AS b, sum(s) AS s, sum(a) AS a FROM k)
    SELECT category, c.b AS bundles, c.s::BIGINT AS segments, c.a::BIGINT AS addresses, round(c.b / w.b * 100, 1) AS pct_of_bundles, round(c.s / w.s * 100, 1) AS pct_of_segments, round(c.a / w.a * 100, 1) AS pct_of_addresses FROM c, w
""")
def agg18_overlap(spark, sf_dir):
    return balance.overlap(bundles(spark, sf_dir), plan_history(spark, sf_dir))


@query(f"WITH {_PLAN} SELECT date, count(*) AS total_assignments, count(*) FILTER (upper(trim(task)) = 'D2DS') AS d2ds_count, count(*) - count(*) FILTER (upper(trim(task)) = 'D2DS') AS dh_count FROM plan GROUP BY 1")
def agg19_weekly_assignments(spark, sf_dir):
    return history.weekly_assignments(plan_history(spark, sf_dir))


_ELIGIBLE = f"{ACTIVITIES}, {BUNDLES}, elig AS (SELECT DISTINCT week_start + 7 AS week_start, bundle_id FROM activities JOIN bundles USING (segment_id)), per AS (SELECT week_start, count(DISTINCT bundle_id) AS eligible_bundles FROM elig GROUP BY 1)"


def _eligible(spark, sf_dir):
    return history.eligible_weeks(activities(spark, sf_dir), bundles(spark, sf_dir))


@query(f"WITH {_ELIGIBLE} SELECT week_start, bundle_id FROM elig")
def jon13_eligible_by_previous_week(spark, sf_dir):
    return _eligible(spark, sf_dir)


@query(f"""
    WITH {_ELIGIBLE} SELECT count(*) AS weeks, round(avg(eligible_bundles), 4) AS mean, median(eligible_bundles) AS median, min(eligible_bundles) AS smallest, max(eligible_bundles) AS largest, round(stddev_samp(eligible_bundles), 4) AS std,
      round(quantile_cont(eligible_bundles, 0.10), 4) AS p10, round(quantile_cont(eligible_bundles, 0.25), 4) AS p25, round(quantile_cont(eligible_bundles, 0.75), 4) AS p75, round(quantile_cont(eligible_bundles, 0.90), 4) AS p90, round(quantile_cont(eligible_bundles, 0.95), 4) AS p95, round(quantile_cont(eligible_bundles, 0.99), 4) AS p99,
      count(*) FILTER (eligible_bundles >= 4) AS weeks_4, count(*) FILTER (eligible_bundles >= 35) AS weeks_35 FROM per
""")
def agg20_eligibility_distribution(spark, sf_dir):
    out = panel.distribution(panel.eligibility_by_week(_eligible(spark, sf_dir)), "eligible_bundles", [4, 35])
    return out.select("weeks", "median", "smallest", "largest", "weeks_4", "weeks_35", *rounded("mean", "std", "p10", "p25", "p75", "p90", "p95", "p99"))


@query(f"WITH {_PANEL}, {BUNDLES} SELECT bundle_id, week_start, count(*) AS total, count(*) FILTER (r = 0) AS unfixed, round(count(*) FILTER (r = 0) / count(*), 4) AS unfixed_rate, bundle_id >= 50 AS is_dh FROM panel JOIN bundles ON segment_id = unit WHERE y = 1 GROUP BY 1, 2")
def agg21_unfixed(spark, sf_dir):
    out = panel.unfixed_by_bundle(_report_panel(spark, sf_dir), bundles(spark, sf_dir), 50)
    return out.withColumn("unfixed_rate", F.round("unfixed_rate", 4))


@query(f"WITH {ACTIVITIES} SELECT weekofyear(week_start)::INTEGER AS week_of_year, count(*) AS n, round(avg(coalesce(closed < CAST(week_start + 7 AS TIMESTAMP), false)::INTEGER), 6) AS contaminated, round(avg((epoch_us(closed) - epoch_us(reported)) / 86400000000.0), 4) AS mean_days FROM activities GROUP BY 1")
def agg22_fix_timing(spark, sf_dir):
    out = panel.fix_timing(activities(spark, sf_dir))
    return out.select("week_of_year", "n", F.round("contaminated", 6).alias("contaminated"), F.round("mean_days", 4).alias("mean_days"))


@query(f"""
    WITH {_PANEL}, w AS (SELECT week_start, sum(y)::BIGINT AS n_segments, sum(coalesce(r, 0))::BIGINT AS n_fixed FROM panel GROUP BY 1)
    SELECT *, n_segments - n_fixed AS n_unfixed, round(n_fixed / nullif(n_segments, 0) * 100, 4) AS pct_fixed, CASE WHEN n_segments = 0 THEN 'no_potholes' WHEN n_fixed = 0 THEN 'all_unfixed' WHEN n_fixed = n_segments THEN 'all_fixed' ELSE 'good_variation' END AS issue, n_segments > 0 AND n_fixed > 0 AND n_fixed < n_segments AS has_variation FROM w
""")
def agg23_treatment_variation(spark, sf_dir):
    out = panel.variation_labels(_report_panel(spark, sf_dir)).drop("pct_unfixed")
    return out.withColumn("pct_fixed", F.round("pct_fixed", 4))


@query(f"WITH {_PANEL} SELECT week_start, round(least(1, greatest(0, avg(r))), 6) AS r_hat FROM panel WHERE y = 1 GROUP BY 1")
def agg25_week_effects(spark, sf_dir):
    return panel.week_effects(_report_panel(spark, sf_dir)).select("week_start", F.round("r_hat", 6).alias("r_hat"))


_SEASON = f"WITH {ACTIVITIES}, w AS (SELECT week_start, count(*) AS n FROM activities GROUP BY 1)"


def _weekly_reports(spark, sf_dir):
    return activities(spark, sf_dir).groupBy("week_start").agg(F.count("*").alias("n"))


@query(f"""
    {_SEASON} SELECT weekofyear(week_start)::INTEGER AS week_of_year, round(avg(n) FILTER (year(week_start) = 1996), 4) AS y1996, round(avg(n) FILTER (year(week_start) = 1997), 4) AS y1997, round(avg(n) FILTER (year(week_start) = 1998), 4) AS y1998 FROM w GROUP BY 1
""")
def agg26_seasonal_pivot(spark, sf_dir):
    out = panel.seasonal_pivot(_weekly_reports(spark, sf_dir), "n", [1996, 1997, 1998])
    return out.select("week_of_year", *rounded("y1996", "y1997", "y1998"))


@query(f"{_SEASON} SELECT weekofyear(week_start)::INTEGER AS week_of_year, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS std FROM w GROUP BY 1")
def agg20_seasonal_spread(spark, sf_dir):
    return panel.seasonal_spread(_weekly_reports(spark, sf_dir), "n").select("week_of_year", *rounded("mean", "std"))


_SURVEYED = "surveyed AS (SELECT DISTINCT segment_id, bundle_id, DATE '1997-01-04' + 7 * (segment_id % 50)::INTEGER AS survey_week FROM bundles)"
_EXPOSED = f"WITH {_PANEL}, {BUNDLES}, {_SURVEYED}, e AS (SELECT s.*, coalesce(y, 0) AS y1, coalesce(r, 0) AS r1 FROM surveyed s LEFT JOIN panel ON unit = segment_id AND week_start = survey_week)"


def _surveyed(spark, sf_dir):
    k = F.col("segment_id")
    return bundles(spark, sf_dir).select(k, "bundle_id", F.date_add(F.lit(dt.date(1997, 1, 4)), (7 * (k % 50)).cast("int")).alias("survey_week"))


@query(f"{_EXPOSED} SELECT segment_id, survey_week, y1 AS y, r1 AS r FROM e")
def jon17_exposure_join(spark, sf_dir):
    p = _report_panel(spark, sf_dir).select(F.col("unit").alias("segment_id"), F.col("week_start").alias("survey_week"), "y", "r")
    out = _surveyed(spark, sf_dir).join(p, ["segment_id", "survey_week"], "left")
    return out.select("segment_id", "survey_week", F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("r", F.lit(0)).alias("r"))


@query(f"{_EXPOSED} SELECT bundle_id, count(*) AS segments, sum(y1)::BIGINT AS potholes, sum(r1)::BIGINT AS fixed, sum((y1 = 1 AND r1 = 1)::INTEGER)::BIGINT AS treatment, sum((y1 = 1 AND r1 = 0)::INTEGER)::BIGINT AS control FROM e GROUP BY 1")
def agg28_exposure(spark, sf_dir):
    return panel.exposure(_surveyed(spark, sf_dir), _report_panel(spark, sf_dir))


@query(f"""
    WITH {BUNDLES}, t AS (SELECT bundle_id, sum(n_addresses) AS total FROM bundles GROUP BY 1), a AS (SELECT count(*) AS bundles_before, sum(s) AS segments_before, sum(z) AS addresses_before, avg(z) AS mean_before FROM (SELECT bundle_id, count(*) AS s, sum(n_addresses) AS z FROM bundles GROUP BY 1)),
    b AS (SELECT count(*) AS bundles_after, sum(s) AS segments_after, sum(z) AS addresses_after, avg(z) AS mean_after FROM (SELECT bundle_id, count(*) AS s, sum(n_addresses) AS z FROM bundles WHERE bundle_id IN (SELECT bundle_id FROM t WHERE total BETWEEN 72 AND 88) GROUP BY 1))
    SELECT bundles_before, bundles_after, addresses_before::BIGINT AS addresses_before, addresses_after::BIGINT AS addresses_after, round(mean_before, 4) AS mean_before, round(mean_after, 4) AS mean_after, round((bundles_before - bundles_after) / bundles_before, 6) AS bundles_lost, round((segments_before - segments_after) / segments_before, 6) AS segments_lost FROM a, b
""")
def agg30_representativeness(spark, sf_dir):
    rows = bundles(spark, sf_dir)
    kept = rows.join(filters.size_band(rows, "bundle_id", "n_addresses", 80.0).where("kept"), "bundle_id", "left_semi")
    out = balance.representativeness(rows, kept)
    return out.select("bundles_before", "bundles_after", "addresses_before", "addresses_after", *rounded("mean_before", "mean_after"), *rounded("bundles_lost", "segments_lost", digits=6))


@query(f"""
    WITH {BUNDLES}, r AS (SELECT DISTINCT 'W' || bundle_id % 5 AS interviewer, 'DH' AS task, segment_id FROM bundles), c AS (SELECT segment_id, n_addresses AS n FROM bundles WHERE n_addresses > 0 AND segment_id % 2 = 0)
    SELECT interviewer, task, count(*) AS n_segments, sum(coalesce(n, 0))::BIGINT AS n_targets, count(*) FILTER (coalesce(n, 0) = 0) AS n_zero FROM r LEFT JOIN c USING (segment_id) GROUP BY 1, 2
""")
def agg31_zero_targets(spark, sf_dir):
    rows = bundles(spark, sf_dir)
    routes = rows.select(F.concat(F.lit("W"), (F.col("bundle_id") % 5).cast("string")).alias("interviewer"), F.lit("DH").alias("task"), "segment_id")
    return balance.zero_targets(routes, rows.where("n_addresses > 0 and segment_id % 2 = 0").select("segment_id", F.col("n_addresses").alias("n")))


@query("""
    WITH s AS (SELECT c_custkey AS segment_id, 10 AS total, c_custkey % 12 AS n FROM customer)
    SELECT segment_id, n AS n_treated, n / 10 AS share, CASE WHEN n / 10 >= 0.9 THEN 'Full' WHEN n / 10 BETWEEN 0.4 AND 0.6 THEN 'Partial' WHEN n / 10 < 0.1 THEN 'Control' WHEN n / 10 > 0.7 THEN 'Full' WHEN n / 10 > 0.3 THEN 'Partial' ELSE 'Control' END AS dh_arm FROM s
""")
def agg32_infer_arms(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    points = rows.select(k.alias("segment_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), k % 12)).alias("i")).where("i > 0")
    return balance.infer_arms(points, rows.select(k.alias("segment_id"), F.lit(10).alias("total"))).select("segment_id", "n_treated", "share", "dh_arm")


@query(f"WITH {BUNDLES} SELECT bundle_id, count(*) AS addresses FROM bundles JOIN (SELECT o_custkey AS segment_id FROM orders) USING (segment_id) GROUP BY 1")
def agg34_addresses_per_bundle(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("segment_id"))
    return points.join(bundles(spark, sf_dir), "segment_id").groupBy("bundle_id").agg(F.count("*").alias("addresses"))


_CENSUS = "cens AS (SELECT c_custkey AS unit, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 100 + c_custkey % 50 END AS total, c_custkey % 40 AS hispanic, c_custkey % 30 AS white, CASE WHEN c_custkey % 17 = 0 THEN -666666666 ELSE c_acctbal END AS income, c_custkey % 5 AS d1, c_custkey % 7 AS d2, 60 + c_custkey % 9 AS adults FROM customer)"


def _census(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("unit"), F.when(k % 13 == 0, 0).otherwise(100 + k % 50).alias("total"), (k % 40).alias("hispanic"), (k % 30).alias("white"),
        F.when(k % 17 == 0, -666666666.0).otherwise(F.col("c_acctbal")).alias("income"), (k % 5).alias("d1"), (k % 7).alias("d2"), (60 + k % 9).alias("adults"),
    )


@query(f"WITH {_CENSUS} SELECT unit, round(hispanic / nullif(total, 0), 6) AS share_hispanic, round(white / nullif(total, 0), 6) AS share_white, CASE WHEN income < 0 THEN NULL ELSE income END AS income, round((d1 + d2) / adults, 6) AS share_college FROM cens")
def agg35_census_shares(spark, sf_dir):
    out = census.shares(_census(spark, sf_dir), "total", {"share_hispanic": "hispanic", "share_white": "white"}, "income", ["d1", "d2"], "adults")
    return out.select("unit", *rounded("share_hispanic", "share_white", digits=6), "income", F.round("share_college", 6).alias("share_college"))


@query(f"""
    WITH {_CENSUS}, s AS (SELECT unit, hispanic / nullif(total, 0) AS h, CASE WHEN income < 0 THEN NULL ELSE income END AS i FROM cens)
    SELECT sample, count(*) AS n_segments, round(avg(h), 6) AS share_hispanic, round(avg(i), 2) AS income FROM (SELECT 'all' AS sample, * FROM s UNION ALL SELECT 'eligible', * FROM s WHERE unit % 2 = 0 UNION ALL SELECT 'bundled', * FROM s WHERE unit % 6 = 0) GROUP BY 1
""")
def agg29_sample_means(spark, sf_dir):
    rows = census.shares(_census(spark, sf_dir), "total", {"share_hispanic": "hispanic"}, "income", ["d1", "d2"], "adults").withColumnRenamed("unit", "segment_id")
    keys = lambda m: rows.where(F.col("segment_id") % m == 0).select("segment_id")
    out = census.sample_means(rows, {"all": None, "eligible": keys(2), "bundled": keys(6)}, ["share_hispanic", "income"])
    return out.select("sample", "n_segments", F.round("share_hispanic", 6).alias("share_hispanic"), F.round("income", 2).alias("income"))


@query("SELECT (SELECT count(*) FROM part) AS segments, (SELECT count(*) FROM customer) AS addresses, count(*) AS events, count(DISTINCT user_id) AS units, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events")
def agg36_diagnostics(spark, sf_dir):
    return history.diagnostics({"segments": table(spark, sf_dir, "part"), "addresses": table(spark, sf_dir, "customer")}, table(spark, sf_dir, "events"), "user_id", "ts")
