"""Queries of the spatial joins; their SQL compares all pairs, which only small tables allow."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geo, text
from kerbline.operators import filters, panel, spatial
from kerbline.operators.bundling import network_components
from kerbline.plans.registry import ADDRESSES, STREETS, ZONES, addresses, query, rounded, streets, table, zones

REACH = 120.0
_EDGES = "edges AS (SELECT segment_id, name, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM streets UNION ALL SELECT segment_id, name, x2, y2, x3, y3 FROM streets)"
_NEAR = f"""
    {ADDRESSES}, {STREETS}, {_EDGES},
    t AS (SELECT addr_id, segment_id, a.x, a.y, ax, ay, bx - ax AS dx, by_ - ay AS dy, a.name AS an, e.name AS en,
        CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 > 0 THEN greatest(0.0, least(1.0, ((a.x - ax) * (bx - ax) + (a.y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) ELSE 0 END AS t FROM addresses a CROSS JOIN edges e),
    near AS (SELECT addr_id, segment_id, any_value(an) AS an, any_value(en) AS en, min(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)) AS dist FROM t GROUP BY 1, 2 HAVING min(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)) <= {REACH})
"""
_KEY = "replace(replace(replace(upper(trim({0})), 'STREET', 'ST'), 'AVENUE', 'AVE'), 'ROAD', 'RD')"
_CLEAN = "replace(replace({0}, '.', ''), ',', '')"
_A, _E = (_CLEAN.format(_KEY.format(c)) for c in ("an", "en"))


@query(f"""
    WITH {_NEAR} SELECT addr_id, segment_id, round(dist, 6) AS dist FROM near
    QUALIFY row_number() OVER (PARTITION BY addr_id ORDER BY dist, NOT ({_A} <> '' AND {_E} <> '' AND (contains({_A}, {_E}) OR contains({_E}, {_A}))), segment_id) = 1
""")
def jon01_nearest_with_name(spark, sf_dir):
    match = text.names_match(text.street_key(F.col("name")), text.street_key(F.col("line_name")))
    out = spatial.nearest_line(addresses(spark, sf_dir), streets(spark, sf_dir), REACH, match)
    return out.select("addr_id", "segment_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {_NEAR} SELECT addr_id, segment_id, round(dist, 6) AS dist FROM near QUALIFY row_number() OVER (PARTITION BY addr_id ORDER BY dist, segment_id) = 1")
def jon02_nearest(spark, sf_dir):
    out = spatial.nearest_line(addresses(spark, sf_dir), streets(spark, sf_dir), REACH)
    return out.select("addr_id", "segment_id", F.round("dist", 6).alias("dist"))


def _crosses(a: str, b: str) -> str:
    ax, ay, bx, by = f"{a}x", "ay" if a == "a" else ("by_" if a == "b" else f"{a}y"), f"{b}x", "ay" if b == "a" else ("by_" if b == "b" else f"{b}y")
    return f"(CASE WHEN ({ay} > y) <> ({by} > y) THEN x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax} ELSE FALSE END)::INTEGER"


_INSIDE = f"({_crosses('a', 'b')} + {_crosses('b', 'g')} + {_crosses('g', 'h')} + {_crosses('h', 'a')}) % 2 = 1"


@query(f"WITH {ADDRESSES}, {ZONES} SELECT addr_id, zone_id, zone_name FROM addresses LEFT JOIN zones ON {_INSIDE}")
def jon03_point_in_polygon(spark, sf_dir):
    points = addresses(spark, sf_dir).select("addr_id", "x", "y")
    return spatial.points_with_rings(points, zones(spark, sf_dir), 300.0, outer=True).select("addr_id", "zone_id", "zone_name")


@query(f"""
    WITH {ADDRESSES}, {ZONES}, n AS (SELECT addr_id // 30 AS bundle_id, zone_name, count(*) AS c FROM addresses JOIN zones ON {_INSIDE} GROUP BY 1, 2),
    m AS (SELECT bundle_id, zone_name FROM n QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY c DESC, zone_name) = 1)
    SELECT bundle_id, zone_name FROM (SELECT DISTINCT addr_id // 30 AS bundle_id FROM addresses) LEFT JOIN m USING (bundle_id)
""")
def jon04_modal_district(spark, sf_dir):
    points = addresses(spark, sf_dir).select(F.floor(F.col("addr_id") / 30).alias("bundle_id"), "x", "y")
    return spatial.modal(spatial.points_with_rings(points, zones(spark, sf_dir).drop("zone_id"), 300.0, outer=True), "bundle_id", "zone_name")


_BOXES = "boxes AS (SELECT s_suppkey AS zone_id, ((s_suppkey * 3571) % 10007)::DOUBLE - 400.5 AS lx, ((s_suppkey * 7877) % 10009)::DOUBLE - 400.5 AS ly FROM supplier)"


@query(f"""
    WITH {STREETS}, {_EDGES}, {_BOXES},
    c AS (SELECT segment_id, zone_id, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS l,
        greatest(0.0, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN lx AND lx + 801 THEN 0 ELSE 2 END ELSE least((lx - ax) / (bx - ax), (lx + 801 - ax) / (bx - ax)) END, CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN ly AND ly + 801 THEN 0 ELSE 2 END ELSE least((ly - ay) / (by_ - ay), (ly + 801 - ay) / (by_ - ay)) END) AS t0,
        least(1.0, CASE WHEN bx = ax THEN 1 ELSE greatest((lx - ax) / (bx - ax), (lx + 801 - ax) / (bx - ax)) END, CASE WHEN by_ = ay THEN 1 ELSE greatest((ly - ay) / (by_ - ay), (ly + 801 - ay) / (by_ - ay)) END) AS t1
      FROM edges JOIN boxes ON true),
    o AS (SELECT segment_id, zone_id, sum(l * greatest(t1 - t0, 0)) AS overlap FROM c GROUP BY 1, 2)
    SELECT segment_id, round(max(overlap), 4) AS overlap FROM o WHERE overlap > 0 GROUP BY 1
""")
def jon05_largest_overlap(spark, sf_dir):
    k = F.col("s_suppkey")
    lx, ly = (k * 3571 % 10007).cast("double") - 400.5, (k * 7877 % 10009).cast("double") - 400.5
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rings = table(spark, sf_dir, "supplier").select(k.alias("zone_id"), F.array(corner(lx, ly), corner(lx + 801, ly), corner(lx + 801, ly + 801), corner(lx, ly + 801)).alias("ring"))
    return spatial.largest_overlap(streets(spark, sf_dir), rings, 400.0).select("segment_id", F.round("overlap", 4).alias("overlap"))


_SIDE = "sign(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))"


def _point_edge(px: str, py: str, s: str) -> str:
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.by_ - {s}.ay)"
    t = f"(CASE WHEN {dx} ** 2 + {dy} ** 2 > 0 THEN greatest(0.0, least(1.0, (({px} - {s}.ax) * {dx} + ({py} - {s}.ay) * {dy}) / ({dx} ** 2 + {dy} ** 2))) ELSE 0 END)"
    return f"sqrt(({px} - {s}.ax - {t} * {dx}) ** 2 + ({py} - {s}.ay - {t} * {dy}) ** 2)"


_S = [_SIDE.format(*x) for x in (("p.ax", "p.ay", "p.bx", "p.by_", "q.ax", "q.ay"), ("p.ax", "p.ay", "p.bx", "p.by_", "q.bx", "q.by_"), ("q.ax", "q.ay", "q.bx", "q.by_", "p.ax", "p.ay"), ("q.ax", "q.ay", "q.bx", "q.by_", "p.bx", "p.by_"))]
_GAP = f"CASE WHEN {_S[0]} * {_S[1]} < 0 AND {_S[2]} * {_S[3]} < 0 THEN 0 ELSE least({_point_edge('p.ax', 'p.ay', 'q')}, {_point_edge('p.bx', 'p.by_', 'q')}, {_point_edge('q.ax', 'q.ay', 'p')}, {_point_edge('q.bx', 'q.by_', 'p')}) END"
_TOUCH = f"touch AS (SELECT DISTINCT p.segment_id AS src, q.segment_id AS dst FROM edges p JOIN edges q ON p.segment_id < q.segment_id AND abs(p.ax - q.ax) < 400 AND abs(p.ay - q.ay) < 400 WHERE {_GAP} <= 50)"


@query(f"WITH {STREETS}, {_EDGES}, {_TOUCH} SELECT src, dst FROM touch")
def jon06_adjacent_segments(spark, sf_dir):
    return spatial.touching_lines(streets(spark, sf_dir), 25.0)


@query(f"""
    WITH RECURSIVE {STREETS}, {_EDGES}, {_TOUCH}, both_ AS MATERIALIZED (SELECT src, dst FROM touch UNION ALL SELECT dst, src FROM touch),
    reach(node, top) AS (SELECT segment_id, segment_id FROM streets UNION SELECT b.dst, r.top FROM reach r JOIN both_ b ON b.src = r.node AND r.top < b.dst)
    SELECT node AS segment_id, min(top) AS component_id FROM reach GROUP BY 1
""")
def grf01_connected_components(spark, sf_dir):
    return network_components(streets(spark, sf_dir), 25.0)[0]


@query(f"WITH {ADDRESSES}, {ZONES}, l AS (SELECT addr_id, zone_name FROM addresses LEFT JOIN zones ON {_INSIDE}) SELECT addr_id FROM l WHERE zone_name IN ('Z1', 'Z3')")
def flt05_zoning_include(spark, sf_dir):
    labelled = spatial.left_points_in_rings(addresses(spark, sf_dir).drop("name"), zones(spark, sf_dir), 300.0, "zone_name")
    return filters.by_label(labelled, "zone_name", ["Z1", "Z3"], "include").select("addr_id")


@query(f"WITH {ADDRESSES}, {ZONES}, l AS (SELECT addr_id, zone_name FROM addresses LEFT JOIN zones ON {_INSIDE}) SELECT addr_id FROM l WHERE zone_name IS NULL OR zone_name NOT IN ('Z2')")
def flt06_district_exclusion(spark, sf_dir):
    labelled = spatial.left_points_in_rings(addresses(spark, sf_dir).drop("name"), zones(spark, sf_dir), 300.0, "zone_name")
    return filters.by_label(labelled, "zone_name", ["Z2"], "exclude").select("addr_id")


@query(f"""
    WITH {STREETS}, {ZONES}, b AS (SELECT min(least(x1, x2, x3)) - 1000 AS x0, min(least(y1, y2, y3)) - 1000 AS y0, max(greatest(x1, x2, x3)) + 1000 AS x9, max(greatest(y1, y2, y3)) + 1000 AS y9 FROM streets WHERE segment_id % 50 = 3 AND x1 < 3000 AND y1 < 3000)
    SELECT zone_id FROM zones, b WHERE greatest(ax, bx, gx, hx) >= x0 AND least(ax, bx, gx, hx) <= x9 AND greatest(ay, by_, gy, hy) >= y0 AND least(ay, by_, gy, hy) <= y9
""")
def flt13_extent_clip(spark, sf_dir):
    lines = streets(spark, sf_dir).where("segment_id % 50 = 3").where((F.col("line")[0]["x"] < 3000) & (F.col("line")[0]["y"] < 3000))
    return spatial.clip_to_extent(zones(spark, sf_dir), lines, 1000.0).select("zone_id")


_GRID = " UNION ALL ".join(f"SELECT segment_id, {b} AS b, {m} AS m, count(*) AS n FROM best WHERE dist <= {b} GROUP BY 1 HAVING count(*) >= {m}" for b in (60, 120) for m in (1, 2))


@query(f"""
    WITH {_NEAR}, best AS (SELECT addr_id, segment_id, dist FROM near QUALIFY row_number() OVER (PARTITION BY addr_id ORDER BY dist, segment_id) = 1), g AS ({_GRID}),
    l AS (SELECT segment_id, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) AS length FROM streets)
    SELECT 'b' || b || '_m' || m AS scenario, count(*) AS n_segments, sum(n)::BIGINT AS sum_addresses, round(median(length), 4) AS median_length, round(median(n / nullif(length, 0) * 100), 4) AS median_density FROM g JOIN l USING (segment_id) GROUP BY 1
""")
def agg03_scenario_summary(spark, sf_dir):
    lines = streets(spark, sf_dir)
    near = spatial.nearest_line(addresses(spark, sf_dir), lines, REACH)
    out = panel.scenario_summary(near, lines.select("segment_id", geo.length(F.col("line")).alias("length")), [60.0, 120.0], [1, 2])
    return out.select("scenario", "n_segments", "sum_addresses", *rounded("median_length", "median_density"))


_WORKERS = "workers AS (SELECT n_name AS name, 32.5 + n_nationkey / 60.0 AS lat, -117.3 + (n_nationkey * 7 % 25) / 60.0 AS lon FROM nation)"
_JOBS = "jobs AS (SELECT s_suppkey AS bundle_id, 32.55 + (s_suppkey % 37) / 100.0 AS lat, -117.25 + (s_suppkey % 29) / 90.0 AS lon FROM supplier)"
_KM = "2 * 6371 * atan2(sqrt(a), sqrt(1 - a))"
_HAV = "power(sin(radians(j.lat - w.lat) / 2), 2) + cos(radians(w.lat)) * cos(radians(j.lat)) * power(sin(radians(j.lon - w.lon) / 2), 2) AS a"


def workers(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (32.5 + k / 60.0).alias("lat"), (-117.3 + (k * 7 % 25) / 60.0).alias("lon"))


def jobs(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("bundle_id"), (32.55 + (k % 37) / 100.0).alias("lat"), (-117.25 + (k % 29) / 90.0).alias("lon"))


@query(f"WITH {_WORKERS}, {_JOBS} SELECT name, bundle_id, round({_KM}, 6) AS km FROM (SELECT name, bundle_id, {_HAV} FROM workers w CROSS JOIN jobs j)")
def jon14_cost_matrix(spark, sf_dir):
    return spatial.cost_matrix(workers(spark, sf_dir), jobs(spark, sf_dir)).select("name", "bundle_id", F.round("km", 6).alias("km"))


@query(f"""
    WITH {ADDRESSES}, {STREETS} SELECT segment_id % 40 AS grp, arg_min(addr_id, (round(sqrt((a.x - s.x1) ** 2 + (a.y - s.y1) ** 2), 6), addr_id)) AS start_addr, round(min(sqrt((a.x - s.x1) ** 2 + (a.y - s.y1) ** 2)), 6) AS dist
    FROM streets s JOIN addresses a ON a.addr_id % 40 = s.segment_id % 40 GROUP BY 1
""")
def jon15_nearest_in_group(spark, sf_dir):
    a = addresses(spark, sf_dir).select("addr_id", "x", "y", (F.col("addr_id") % 40).alias("grp"))
    p = geo.first_point(F.col("line"))
    s = streets(spark, sf_dir).select((F.col("segment_id") % 40).alias("grp"), p["x"].alias("x"), p["y"].alias("y"))
    return spatial.nearest_in_group(a, s, "grp", "addr_id").select("grp", F.col("addr_id").alias("start_addr"), "dist")
