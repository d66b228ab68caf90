"""Queries of bundles, walks and assignments: projections with SQL where there is one, else whole results covered by property tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kerbline.operators import assignment, bundling, solvers
from kerbline.plans.registry import query, table
from kerbline.plans.spatial_joins import _HAV, _JOBS, _KM, _WORKERS, jobs, workers

#: A street grid of 30 x 30 nodes, 100 m apart: p_partkey 1 .. 870 are the edges to the east, 871 .. 1740 those to the north; n addresses each.
_GRID = """
    grid AS (SELECT p_partkey AS segment_id, CASE WHEN p_partkey <= 870 THEN (p_partkey - 1) % 29 ELSE (p_partkey - 871) // 29 END AS i, CASE WHEN p_partkey <= 870 THEN (p_partkey - 1) // 29 ELSE (p_partkey - 871) % 29 END AS j,
        p_partkey <= 870 AS east, 5 + (p_partkey * 7919) % 20 AS n, p_partkey // 8 AS bundle_id FROM part WHERE p_partkey BETWEEN 1 AND 1740),
    ends AS (SELECT segment_id, bundle_id, i * 200 || ':' || j * 200 AS a, (i + east::INTEGER) * 200 || ':' || (j + (NOT east)::INTEGER) * 200 AS b FROM grid)
"""


def grid(spark, sf_dir, size: int = 30):
    """(segment_id, line, n, bundle_id) of the grid network; ``bundle_id`` cuts it into runs of eight segments."""
    k, east = F.col("p_partkey"), size * (size - 1)
    first = k <= east
    r, q = (k - 1) % (size - 1), F.floor((k - 1) / (size - 1))
    r2, q2 = (k - 1 - east) % (size - 1), F.floor((k - 1 - east) / (size - 1))
    i, j = F.when(first, r).otherwise(q2), F.when(first, q).otherwise(r2)
    point = lambda x, y: F.struct((x * 100.0).alias("x"), (y * 100.0).alias("y"))
    line = F.array(point(i, j), point(i + first.cast("int"), j + (~first).cast("int")))
    rows = table(spark, sf_dir, "part").where(k.between(1, 2 * east))
    return rows.select(k.alias("segment_id"), line.alias("line"), (5 + k * 7919 % 20).alias("n"), F.floor(k / 8).alias("bundle_id"))


@query(f"WITH {_GRID}, d AS (SELECT bundle_id, node, count(*) AS degree FROM (SELECT bundle_id, unnest([a, b]) AS node FROM ends) GROUP BY 1, 2) SELECT bundle_id, count(*) AS nodes, sum(degree % 2)::BIGINT AS odd_nodes FROM d GROUP BY 1")
def grf14_odd_nodes(spark, sf_dir):
    rows = grid(spark, sf_dir)
    return bundling.odd_counts(rows.select("segment_id", "bundle_id"), bundling.segment_facts(rows))


@query(f"""
    WITH RECURSIVE {_GRID}, links AS (SELECT bundle_id, a, b FROM ends UNION SELECT bundle_id, b, a FROM ends),
    reach(bundle_id, node, top) AS (SELECT DISTINCT bundle_id, a, a FROM links UNION SELECT r.bundle_id, l.b, r.top FROM reach r JOIN links l ON l.bundle_id = r.bundle_id AND l.a = r.node),
    c AS (SELECT bundle_id, node, min(top) AS comp FROM reach GROUP BY 1, 2)
    SELECT bundle_id, count(DISTINCT comp) AS pieces, count(DISTINCT comp) = 1 AS connected FROM c GROUP BY 1
""")
def grf02_connected_bundles(spark, sf_dir):
    rows = grid(spark, sf_dir)
    return bundling.connected_bundles(rows.select("segment_id", "bundle_id"), bundling.segment_facts(rows))


def _bundled(spark, sf_dir, method: str):
    table_ = bundling.component_table(grid(spark, sf_dir), reach=1.0)
    return bundling.bundle_segments(table_, 120, method)


@query(f"WITH {_GRID} SELECT segment_id, n, true AS placed FROM grid")
def grf17_greedy_workflow(spark, sf_dir):
    """All segments of the connected grid end in some bundle."""
    return _bundled(spark, sf_dir, "greedy").select("segment_id", "n", F.col("bundle_id").isNotNull().alias("placed"))


@query(f"WITH {_GRID} SELECT segment_id, n, true AS placed, true AS in_limit FROM grid")
def grf18_balanced_workflow(spark, sf_dir):
    """All segments are placed, no bundle of more than one segment exceeds twice the target."""
    out = _bundled(spark, sf_dir, "balanced")
    return out.select("segment_id", "n", F.col("bundle_id").isNotNull().alias("placed"), ((F.col("bundle_addr_total") <= 240) | (F.col("bundle_seg_count") == 1)).alias("in_limit"))


@query()
def grf19_bundles(spark, sf_dir):
    return _bundled(spark, sf_dir, "balanced")


_BLOCKS = f"{_GRID}, blocks AS (SELECT segment_id, (i // 5) * 100 + j // 5 AS block FROM grid)"


def _blocked(spark, sf_dir):
    rows = grid(spark, sf_dir)
    p = F.col("line")[0]
    return rows.select("segment_id", (F.floor(p["x"] / 500) * 100 + F.floor(p["y"] / 500)).alias("bundle_id")), bundling.component_table(rows, reach=1.0)


@query(f"WITH {_BLOCKS} SELECT block AS bundle_id, count(*) AS segments, true AS all_walked, true AS one_start FROM blocks GROUP BY 1")
def grf21_walks(spark, sf_dir):
    """Each block's walk visits all of its segments and starts once."""
    members, facts = _blocked(spark, sf_dir)
    out = bundling.walks(members, facts).groupBy("bundle_id").agg(F.count_distinct("segment_id").alias("walked"), F.sum("start_flag").alias("starts"))
    sizes = members.groupBy("bundle_id").agg(F.count("*").alias("segments"))
    return sizes.join(out, "bundle_id", "left").select("bundle_id", "segments", F.coalesce(F.col("walked") == F.col("segments"), F.lit(False)).alias("all_walked"), F.coalesce(F.col("starts") == 1, F.lit(False)).alias("one_start"))


@query(f"""
    WITH {_BLOCKS}, d AS (SELECT block, node, count(*) AS c FROM (SELECT block, unnest([a, b]) AS node FROM ends JOIN blocks USING (segment_id)) GROUP BY 1, 2)
    SELECT block AS bundle_id, true AS walkable, sum(c % 2)::INTEGER AS odd_before, least(2, sum(c % 2))::INTEGER AS odd_after FROM d GROUP BY 1
""")
def grf20_odd_pairing(spark, sf_dir):
    """Pairing leaves at most two odd nodes in a connected block."""
    members, facts = _blocked(spark, sf_dir)
    return bundling.walk_tests(members, facts).select("bundle_id", "walkable", "odd_before", "odd_after")


@query(f"WITH {_WORKERS}, {_JOBS} SELECT bundle_id, arg_min(name, (round({_KM}, 9), name)) AS name, round(min({_KM}), 6) AS km FROM (SELECT name, bundle_id, {_HAV} FROM workers w CROSS JOIN jobs j) GROUP BY 1")
def asg09_nearest_worker(spark, sf_dir):
    out = assignment.nearest_worker(workers(spark, sf_dir), jobs(spark, sf_dir))
    return out.withColumn("km", F.round("km", 6))


def _dated(spark, sf_dir, per_worker: int = 4, crew: int = 6):
    """Four plan dates of 24 bundles, each with the same crew of six."""
    k = F.col("bundle_id")
    day = F.date_add(F.lit(dt.date(2026, 3, 14)), (7 * F.floor((k - 1) / (per_worker * crew))).cast("int"))
    rows = jobs(spark, sf_dir).where(k.between(1, 4 * per_worker * crew))
    rows = rows.select(day.alias("date"), "bundle_id", "lat", "lon", (0.5 + (k % 7) / 10.0).alias("km"), F.when(k % 2 == 0, "DH").otherwise("D2DS").alias("task"))
    people = workers(spark, sf_dir).orderBy("name").limit(crew)
    return rows, rows.select("date").distinct().crossJoin(F.broadcast(people))


_DATED = f"dated AS (SELECT DATE '2026-03-14' + 7 * ((bundle_id - 1) // 24)::INTEGER AS date, bundle_id FROM (SELECT s_suppkey AS bundle_id FROM supplier) WHERE bundle_id BETWEEN 1 AND 96), crew AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS slot FROM nation QUALIFY slot < 6)"


@query(f"WITH {_DATED} SELECT date, bundle_id, name FROM (SELECT date, bundle_id, (row_number() OVER (PARTITION BY date ORDER BY bundle_id) - 1) % (SELECT count(*) FROM crew) AS slot FROM dated) JOIN crew USING (slot)")
def asg20_round_robin(spark, sf_dir):
    return assignment.deal_in_turn(*_dated(spark, sf_dir))


#: Query names of the assignment methods, by inventory number.
_METHODS = {
    "asg01_optimal": "optimal", "asg04_minimax_greedy": "minimax_greedy", "asg05_minimax_swapped": "minimax_swapped", "asg06_minimax_exact": "minimax_exact", "asg07_minimax_routed": "minimax_routed",
    "asg08_two_stage_routing": "two_stage_routing", "asg09_nearest_then_refine": "nearest_then_refine", "asg11_clustered": "clustered", "asg12_compact_groups": "compact_groups", "asg13_bounded_groups": "bounded_groups",
    "asg14_edge_growth": "edge_growth", "asg15_greedy_compact": "greedy_compact", "asg16_greedy_insertion": "greedy_insertion", "asg17_bisection": "bisection", "asg18_bisection_aware": "bisection_aware", "asg19_bisection_refined": "bisection_refined",
}


def _method(name: str, method: str):
    def run(spark, sf_dir):
        """Each of a date's bundles has one worker of its crew and one place in the route."""
        out = assignment.assign(*_dated(spark, sf_dir), method)
        return out.groupBy("date").agg(F.count("*").alias("bundles"), F.count_distinct("bundle_id").alias("assigned"), F.count_if(F.col("route_km") <= 0).alias("empty_routes"))

    run.__name__ = name
    query(f"WITH {_DATED} SELECT date, count(*) AS bundles, count(DISTINCT bundle_id) AS assigned, 0::BIGINT AS empty_routes FROM dated GROUP BY 1")(run)


for _name, _how in _METHODS.items():
    _method(_name, _how)


@query(f"WITH {_DATED} SELECT date, 6::BIGINT AS dh, 6::BIGINT AS d2ds, 6::BIGINT AS workers FROM dated GROUP BY 1 HAVING count(*) = 24")
def asg10_joint_tasks(spark, sf_dir):
    """Six door-hanger and six survey bundles a date: one of each for each worker."""
    rows, crew = _dated(spark, sf_dir)
    rows = rows.where("(bundle_id - 1) % 24 < 12")
    out = assignment.assign(rows, crew, "joint_tasks").join(rows.select("date", "bundle_id", "task"), ["date", "bundle_id"])
    return out.groupBy("date").agg(F.count_if(F.col("task") == "DH").alias("dh"), F.count_if(F.col("task") == "D2DS").alias("d2ds"), F.count_distinct("name").alias("workers"))


@query()
def asg21_cost_models(spark, sf_dir):
    rows, crew = _dated(spark, sf_dir)
    out = assignment.compare_costs(rows, crew, ["optimal", "nearest_then_refine", "round_robin"])
    return out.select("date", "method", *(F.round(c, 6).alias(c) for c in ("simplified", "routed", "longest")))


@query(f"""
    WITH {_JOBS}, c AS (SELECT bundle_id % 20 AS cluster, * FROM jobs), p AS (SELECT w.cluster, w.bundle_id AS a_, j.bundle_id AS b_, {_HAV} FROM c w JOIN c j ON w.cluster = j.cluster AND w.bundle_id < j.bundle_id)
    SELECT cluster, (SELECT count(*) FROM c x WHERE x.cluster = p.cluster) AS n, round(max({_KM}), 6) AS diameter FROM p GROUP BY 1
""")
def geo08_cluster_spread(spark, sf_dir):
    rows = jobs(spark, sf_dir).select((F.col("bundle_id") % 20).alias("cluster"), F.col("bundle_id").alias("id"), "lat", "lon")
    return assignment.cluster_spread(rows).select("cluster", "n", F.round("diameter", 6).alias("diameter"))


assert set(_METHODS.values()) <= set(solvers.METHODS)
