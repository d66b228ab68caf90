"""Operators of the planning chain on rows with nulls, ties, repeats and empty tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import calendar, geo, text
from kerbline.operators import balance, census, filters, history, panel, ranking, sampling, spatial

D = dt.date


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def test_weeks_at_their_edges(spark):
    stamps = [dt.datetime(2026, 3, 13), dt.datetime(2026, 3, 13, 10), dt.datetime(2026, 3, 14), dt.datetime(2026, 3, 15), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stamps)], "i int, ts timestamp")
    got = rows(df.select("i", calendar.week_start(F.col("ts")), calendar.next_saturday(F.col("ts"))), "i")
    assert got == [(0, D(2026, 3, 7), D(2026, 3, 14)), (1, D(2026, 3, 7), D(2026, 3, 14)), (2, D(2026, 3, 14), D(2026, 3, 21)), (3, D(2026, 3, 14), D(2026, 3, 21)), (4, None, None)]
    kept = lambda **k: {r["i"] for r in filters.in_period(df, "ts", F.lit(D(2026, 3, 7)), F.lit(D(2026, 3, 13)), **k).collect()}
    assert kept() == {0} and kept(inclusive_end=True) == {0, 1}
    span = spark.createDataFrame([(D(2020, 12, 26), D(2025, 12, 27)), (None, D(2026, 1, 1)), (D(2026, 2, 1), D(2026, 1, 1))], "a date, b date")
    assert calendar.saturdays(span, "a", "b").count() == 262


def test_dates_in_any_form(spark):
    forms = ["46095", "46095.0", "2026-3-14", " 3/14/2026 ", "2026-02-30", "soon", "", None, "14/3/2026"]
    df = spark.createDataFrame([(f,) for f in forms], "t string")
    assert [r[0] for r in df.select(calendar.any_date(F.col("t"))).collect()] == [D(2026, 3, 14)] * 4 + [None] * 5
    a, b = dt.datetime(2026, 3, 14, 12), dt.datetime(2026, 3, 14, 11, 59, 59)
    one = spark.createDataFrame([(a, b)], "a timestamp, b timestamp").select(calendar.whole_days(F.col("a"), F.col("b")), calendar.fractional_days(F.col("a"), F.col("b"))).first()
    assert one[0] == -1 and one[1] == pytest.approx(-1 / 86400)


def test_titles_and_addresses(spark):
    names = ["o'farrell 2nd mcgraw-hill", "ÉCOLE d'été", "", "a1b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.title(F.col("n"))).collect()] == [n.title() for n in names]
    parts = [("12", "1/2", "N", "MAPLE", "AV", None, "92101-1234", "12 1/2 N Maple Ave, 92101"), ("0", None, None, None, None, None, None, ""), (None, "", "", "elm  tree", "unknown", "E", "9210", "Elm Tree Unknown E"), ("0000", None, None, "0", None, None, None, "")]
    df = spark.createDataFrame(parts, "a string, b string, c string, d string, e string, f string, g string, want string")
    got = df.select("want", text.address(*(F.col(c) for c in "abcdefg")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_names_that_match(spark):
    pairs = [("Maple Street", "MAPLE ST", True), ("MAPLE ST.", "N Maple St", True), ("", "MAPLE", False), (None, "MAPLE", False), ("Oak Road", "Elm Rd", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.select("want", text.names_match(text.street_key(F.col("a")), text.street_key(F.col("b"))).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_utm_round_trip(spark):
    places = [(32.7157, -117.1611, 484896.0), (33.1, -116.9, 509330.0), (0.001, -117.0, 500000.0)]
    df = spark.createDataFrame(places, "lat double, lon double, x double")
    x, y = geo.lat_lon_to_utm(F.col("lat"), F.col("lon"))
    back = df.select("lat", "lon", F.col("x").alias("near"), x.alias("x"), y.alias("y")).withColumns(dict(zip(("lat2", "lon2"), geo.utm_to_lat_lon(F.col("x"), F.col("y")))))
    for r in back.collect():
        assert abs(r["lat"] - r["lat2"]) < 1e-8 and abs(r["lon"] - r["lon2"]) < 1e-8 and abs(r["x"] - r["near"]) < 60


def test_geometry_of_small_lines(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shape = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(1, line((0, 0), (3, 4), (3, 10))), (2, line((1, 1))), (3, [])], f"i int, line {shape}")
    got = rows(df.select("i", geo.length(F.col("line")), geo.point_to_line(F.lit(3.0), F.lit(12.0), F.col("line"))), "i")
    assert got[0] == (1, 11.0, 2.0) and got[1][1] == 0.0 and got[1][2] == pytest.approx(math.hypot(2, 11)) and got[2][1:] == (0.0, None)
    a = spark.createDataFrame([(line((0, 0), (4, 4)), line((0, 4), (4, 0)), 0.0), (line((0, 0), (1, 0)), line((3, 0), (5, 0)), 2.0)], f"a {shape}, b {shape}, want double")
    assert all(r["want"] == r["got"] for r in a.select("want", geo.line_to_line(F.col("a"), F.col("b")).alias("got")).collect())
    half = spark.createDataFrame([(0.25,), (0.75,), (-0.25,), (1.25,)], "v double")
    assert [r[0] for r in half.select(geo.snap(F.col("v"))).collect()] == [0, 2, 0, 2]


def test_nearest_lines_with_ties(spark):
    shape = "segment_id bigint, line array<struct<x:double,y:double>>, name string"
    line = lambda y: [{"x": -500.0, "y": y}, {"x": 500.0, "y": y}]
    lines = spark.createDataFrame([(1, line(10.0), "OAK ST"), (2, line(-10.0), "ELM ST"), (3, None, "ELM ST")], shape)
    points = spark.createDataFrame([(1, 0.0, 0.0, "Elm Street"), (2, 0.0, 0.0, ""), (3, 0.0, 99.0, "Elm"), (4, 5.0, 11.0, "Elm"), (5, None, 1.0, "Elm")], "addr_id bigint, x double, y double, name string")
    match = text.names_match(text.street_key(F.col("name")), text.street_key(F.col("line_name")))
    assert rows(spatial.nearest_line(points, lines, 40.0, match), "addr_id") == [(1, 2, 10.0), (2, 1, 10.0), (4, 1, 1.0)]
    assert rows(spatial.nearest_line(points, lines, 40.0), "addr_id")[0] == (1, 1, 10.0)
    assert spatial.nearest_line(points, lines.where("false"), 40.0).count() == 0


def test_points_in_overlapping_polygons(spark):
    ring = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    rings = spark.createDataFrame([(1, ring(0, 10), "A"), (2, ring(5, 20), "B")], "zone_id bigint, ring array<struct<x:double,y:double>>, zone_name string")
    points = spark.createDataFrame([(1, 7.0, 7.0), (2, 50.0, 50.0), (3, 1.0, 1.0)], "addr_id bigint, x double, y double")
    labelled = spatial.left_points_in_rings(points, rings, 4.0, "zone_name").select("addr_id", "zone_name")
    assert rows(labelled, "addr_id", "zone_name") == [(1, "A"), (1, "B"), (2, None), (3, "A")]
    assert rows(filters.by_label(labelled, "zone_name", ["A"], "exclude"), "addr_id") == [(1, "B"), (2, None)]
    assert rows(filters.by_label(labelled, "zone_name", ["A"], "exclude", strict=True), "addr_id") == [(1, "B")]


def test_exemptions(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "bundle_id bigint")
    for exempt, gone in ((), {1, 2, 3}), ((2,), {1, 3}), ((1, 2, 3), set()), ((5,), {1, 2, 3}):
        got = sampling.available(ids(*range(1, 11)), ids(1, 2, 3), ids(*exempt), "bundle_id")
        assert {r[0] for r in got.collect()} == set(range(1, 11)) - gone


@pytest.mark.parametrize("n_eligible", [0, 1, 3, 20])
def test_draws_of_short_pools(spark, n_eligible):
    pool = spark.range(1, 101).withColumnRenamed("id", "bundle_id")
    few = pool.where(F.col("bundle_id") <= n_eligible)
    for first, total in ((True, 24), (False, 6)):
        got = sampling.draw_dh(few, pool, first, "s").collect()
        assert len(got) == len({r["bundle_id"] for r in got}) == total
        assert sum(r["bundle_type"] == "conditional" for r in got) == min(4, n_eligible)
    assert len(sampling.draw_dh(few, pool.limit(3), False, "s").collect()) <= 7
    before = pool.where(F.col("bundle_id").isin(50, 51))
    got = sampling.draw_d2ds(before.limit(1), before, few, pool, "s").collect()
    assert len(got) == len({r["bundle_id"] for r in got}) == 6 and sum(r["bundle_type"] == "d2ds_conditional" for r in got) == 2


def test_thinning_and_allocation(spark):
    points = spark.createDataFrame([(s * 10 + i, s, "A", "DH", arm) for s, n, arm in ((1, 0, "Full"), (2, 1, "Partial"), (3, 2, "Partial"), (4, 3, "Partial"), (5, 3, "Full"), (6, 3, None), (7, 2, "odd")) for i in range(n)], "addr_id bigint, segment_id bigint, interviewer string, task string, dh_arm string")
    kept = sampling.thin_segments(points, "2026-03-14").where("dh_selected").groupBy("segment_id").count()
    assert dict(rows(kept)) == {3: 1, 4: 1, 5: 3}
    for n, counts in ((4, (2, 1, 1)), (5, (3, 1, 1)), (7, (3, 2, 2)), (8, (4, 2, 2))):
        out = sampling.allocate_bundles(spark.range(n).select(F.col("id").alias("addr_id"), F.lit(1).alias("bundle_id")), "2026-03-14", "bundle_id").collect()
        assert tuple(sum(r["dh_treatment"] == a for r in out) for a in ("control", "full", "partial")) == counts
        assert sum(r["dh_selected"] for r in out) == counts[1] + counts[2] // 2


def test_balance_statistics(spark):
    got = balance.with_p(balance.two_sample(spark.createDataFrame([(g, v) for g, v in [(True, 1.0), (True, 2.0), (True, 4.0), (True, float("nan")), (False, 3.0), (False, 5.0), (False, 9.0), (False, 7.0), (False, None), (None, 4.0)]], "g boolean, v double"), F.col("g"), "v")).first()
    a, b = [1, 2, 4], [3, 5, 9, 7]
    mean = lambda x: sum(x) / len(x)
    var = lambda x, d: sum((v - mean(x)) ** 2 for v in x) / (len(x) - d)
    assert (got["group1_n"], got["group2_n"]) == (3, 4)
    assert got["std_diff"] == pytest.approx((mean(a) - mean(b)) / math.sqrt((var(a, 0) + var(b, 0)) / 2))
    assert got["t_stat"] == pytest.approx((mean(a) - mean(b)) / math.sqrt(var(a, 1) / 3 + var(b, 1) / 4))
    # The p-value against a sum over the density of Student's distribution.
    v, t = got["dof"], abs(got["t_stat"])
    density = lambda x: math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
    tail = 2 * sum(density(t + (i + 0.5) * 1e-3) * 1e-3 for i in range(200_000))
    assert got["p_value"] == pytest.approx(tail, rel=1e-3)
    flat = balance.two_sample(spark.createDataFrame([(True, 2.0), (True, 2.0), (False, 2.0), (False, 2.0)], "g boolean, v double"), F.col("g"), "v").first()
    assert flat["std_diff"] == 0 and flat["t_stat"] is None
    none = balance.two_sample(spark.createDataFrame([(True, 2.0)], "g boolean, v double"), F.col("g"), "v").first()
    assert none["group1_n"] == 1 and none["group1_mean"] is None and none["std_diff"] is None


def test_size_measures_of_few_bundles(spark):
    empty = balance.size_metrics(spark.createDataFrame([], "size double, segments int"), "size", "segments").first()
    assert empty["n_bundles"] == 0 and empty["cv"] is None and empty["n_outliers"] == 0
    one = balance.quality_report(balance.size_metrics(spark.createDataFrame([(0.0, 1), (None, 2)], "size double, segments int"), "size", "segments")).first()
    assert one["n_bundles"] == 1 and one["ratio"] is None and one["rebalance"] is False
    assert rows(balance.totals(spark.createDataFrame([(1, 2), (1, None), (None, 5)], "b int, v int"), "b", "v")) == [(1, 2, 1)]


def test_panel_of_reports(spark):
    at = lambda d, h=0: dt.datetime(2026, 3, d, h)
    acts = [("a", at(9), at(10)), ("a", at(9), at(13)), ("b", at(9), at(13, 1)), ("b", at(16), None), ("a", at(23), at(24)), ("c", at(10), at(10)), (None, at(9), at(9)), ("c", None, None)]
    df = spark.createDataFrame(acts, "segment_id string, reported timestamp, closed timestamp")
    got = {(r["unit"], r["week_start"].day): (r["n_events"], r["y"], r["r"]) for r in panel.report_panel(df).collect()}
    assert len(got) == 9 and got["a", 7] == (2, 1, 1) and got["b", 7] == (1, 1, 0) and got["b", 14] == (1, 1, 0) and got["a", 14] == (0, 0, None) and got["c", 7] == (1, 1, 1)
    assert panel.report_panel(df.where("false")).count() == 0
    lagged = ranking.lagged(panel.report_panel(df).select("unit", "week_start", "y"), "unit", "week_start", "y")
    assert sum(r["y_lag"] is None for r in lagged.collect()) == 3


def test_effects_of_unbalanced_panels(spark):
    cells = [(u, D(2026, 3, 7 * w + 7), 2.0 * u + w + 1) for u in range(4) for w in range(3) if (u, w) not in {(0, 0), (3, 2)}]
    units, weeks, r2 = panel.two_way_projections(spark.createDataFrame(cells, "unit int, week_start date, v double"), "v")
    a, b = dict(rows(units)), dict(rows(weeks))
    assert r2 == pytest.approx(1) and a[2] - a[1] == pytest.approx(2, abs=1e-6) and b[D(2026, 3, 21)] - b[D(2026, 3, 14)] == pytest.approx(1, abs=1e-6)


def test_leave_one_out_and_cumulative_shares(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 5), (None, 6), ("y", 3)], "g string, v int")
    assert sorted((r["g"] or "", r["v"], r["others"]) for r in panel.leave_one_out(df, "g", "v").collect()) == [("", 5, 6), ("", 6, 5), ("x", 1, 2), ("x", 2, 1), ("y", 3, 0)]
    cume = panel.cumulative_share(spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("x", 5), ("y", 3)], "g string, v int"), "g", "v")
    assert sorted(tuple(r)[1:] for r in cume.collect()) == [(1, 0.5), (1, 0.5), (2, 0.75), (3, 1.0), (5, 1.0)]


def test_choices_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("g", 2, 5.0), ("g", 1, 5.0), ("g", 3, None), ("h", 4, None)], "g string, k int, v double")
    assert rows(ranking.extremes(df, "g", "k", "v")) == [("g", 1, 1)]
    assert [r["k"] for r in ranking.fallback(df, "g", F.col("v") > 9, F.col("k")).orderBy("g").collect()] == [1, 4]
    assert rows(history.last_wins(df, "g", "k", "v"), "g")[0][0] == "g"


def test_history(spark):
    plans = spark.createDataFrame([(D(2026, 1, 10), " dh ", 1, None), (D(2026, 1, 17), "D2DS", 1, None), (D(2026, 1, 17), "DH", 2, None), (None, "DH", 3, None), (D(2026, 1, 17), None, 4, None), (D(2026, 1, 17), "DH", None, None)], "date date, task string, bundle_id bigint, bundle_type string")
    used = {r["bundle_id"]: (r["dh"], r["d2ds"]) for r in history.used_bundles(history.between(plans, but=F.lit(D(2026, 1, 31)))).collect()}
    assert used == {1: (True, True), 2: (True, False), 4: (False, False)}
    assert {r["bundle_id"] for r in history.previous_plan(plans, F.lit(D(2026, 1, 17))).collect()} == {1}
    assert history.previous_plan(plans, F.lit(D(2026, 1, 1))).count() == 0


def test_phases():
    assert filters.require_phase(D(2026, 1, 10))[0] == "official" and filters.require_phase(D(2025, 12, 6))[0] == "pilot"
    with pytest.raises(ValueError):
        filters.require_phase(D(2026, 1, 5))


def test_filters_of_columns_at_hand(spark):
    df = spark.createDataFrame([("G06007", "7"), ("G36007", "8")], "GISJOIN string, other string")
    assert filters.county(df, "007", "G06").count() == 1 and filters.county(df.select("other")).count() == 2
    assert filters.county(df.select(F.col("other").alias("COUNTYA")), "007").count() == 1
    assert filters.addressable(df, "other", None).count() == 0 and filters.addressable(df, None, "other").count() == 2
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, None), (None, 12)], "bundle_id int, segment_id int")
    assert rows(filters.disjoint_groups(members, spark.createDataFrame([(11,)], "segment_id int"), "bundle_id", "segment_id")) == [(2,)]


def test_census(spark):
    units = spark.createDataFrame([(0, 5, -1.0, 1, 0), (10, 5, 7.0, 1, 4)], "pop int, his int, income double, d int, adults int")
    got = census.shares(units, "pop", {"share": "his"}, "income", ["d"], "adults").collect()
    assert (got[0]["share"], got[0]["income"], got[0]["share_college"]) == (None, None, None) and (got[1]["share"], got[1]["income"], got[1]["share_college"]) == (0.5, 7.0, 0.25)
    text_ = census.formatted(spark.createDataFrame([(1234.5, 0.5)], "m double, p double"), ["m"], ["p"]).first()
    assert text_["m"] in ("$1,234", "$1,235") and text_["p"] == "50.0%"
