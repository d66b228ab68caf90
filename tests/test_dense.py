"""Spatial joins where rows are many for the area: against plain loops, and without work or broadcasts that follow the number of pairs."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.operators import panel, spatial, tiles

LINE = "segment_id bigint, line array<struct<x:double,y:double>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_lines(n, side, seed=1, points=(1, 2, 3, 4), step=8):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        line = [(float(rng.randrange(side)), float(rng.randrange(side)))]
        while len(line) < rng.choice(points):
            line.append((line[-1][0] + rng.randint(-step, step), line[-1][1] + rng.randint(-step, step)))
        out.append((k, line))
    return out


def to_edge(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / n)) if n else 0.0
    return math.sqrt((px - a[0] - t * dx) ** 2 + (py - a[1] - t * dy) ** 2)


def apart(p, q):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = math.inf
    for a, b in zip(p, p[1:]):
        for c, d in zip(q, q[1:]):
            cross = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
            out = min(out, 0.0 if cross else min(to_edge(*a, c, d), to_edge(*b, c, d), to_edge(*c, a, b), to_edge(*d, a, b)))
    return out


@pytest.mark.parametrize("long", [False, True])
def test_touching_lines(spark, long):
    lines = random_lines(120, 200) + ([(500, [(0.0, 0.0), (190.0, 170.0)]), (501, [(float(5 * k), float(k % 3)) for k in range(30)])] if long else [])
    frame = spark.createDataFrame(lines, LINE).repartition(3)
    got = spatial.touching_lines(frame, 2.0)
    want = {(p, q) for p, a in lines for q, b in lines if p < q and apart(a, b) <= 4.0}
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    if not long:
        # Pairs of short lines come once, without a shuffle of all pairs.
        assert "HashAggregate" not in plan(got) and "BroadcastHashJoin" not in plan(got)


SQUARES = "zone_id bigint, zone_name string, ring array<struct<x:double,y:double>>"


def random_rings(n, side, seed=2):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y, w = rng.randrange(side), rng.randrange(side), rng.randint(10, 40)
        ring = [(x - w, y - w), (x + w, y - w / 2), (x + w / 2, y + w), (x - w, y + w / 2), (x - w / 2, y)][: rng.choice((4, 5))]
        out.append((k, f"Z{k % 3}", [(float(a), float(b)) for a, b in ring]))
    return out


def within(px, py, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_largest_overlap(spark):
    # Lines wider than a tile take another path; both are held against fine steps along the lines.
    lines = random_lines(60, 200, points=(2, 3)) + [(500, [(0.0, 0.5), (190.0, 170.5)])]
    rings = random_rings(40, 200)
    got_frame = spatial.largest_overlap(spark.createDataFrame(lines, LINE), spark.createDataFrame(rings, SQUARES), 40.0)
    got = {r["segment_id"]: (r["zone_id"], r["overlap"]) for r in got_frame.collect()}
    steps = 2000

    def share(line, ring):
        total = 0.0
        for a, b in zip(line, line[1:]):
            hits = sum(within(a[0] + (k + 0.5) / steps * (b[0] - a[0]), a[1] + (k + 0.5) / steps * (b[1] - a[1]), ring) for k in range(steps))
            total += hits / steps * math.dist(a, b)
        return total

    for key, line in lines[::4]:
        shares = {z: share(line, ring) for z, _, ring in rings}
        most = max(shares.values())
        if most > 0.5:
            zone, overlap = got[key]
            assert abs(overlap - most) < 0.2 and abs(shares[zone] - most) < 0.2
        full = [z for z, s in shares.items() if s and abs(s - sum(map(math.dist, line, line[1:]))) < 1e-9]
        if full:
            assert got[key][0] == min(full)
    # The kernel compares; lines and rings are not joined row by row and sorted by pair.
    assert "tiles" in spatial.largest_overlap.__globals__ and "MapInArrow" in plan(got_frame)


def test_nearest_line(spark):
    lines = random_lines(400, 100, points=(2, 3)) + [(900, [(400.0, 0.0), (400.0, 50.0)])]
    rng = random.Random(3)
    points = [(k, float(rng.randrange(120)), float(rng.randrange(120))) for k in range(200)] + [(700, 430.0, 20.0), (701, 900.0, 900.0), (702, None, 1.0)]
    want = []
    for key, x, y in points:
        far = [(min(to_edge(x, y, a, b) for a, b in zip(line, line[1:])), k) for k, line in lines] if x is not None else []
        if far and min(far)[0] <= 40.0:
            want.append((key, min(far)[1], min(far)[0]))
    frame = spark.createDataFrame(points, "addr_id bigint, x double, y double")
    got = spatial.nearest_line(frame, spark.createDataFrame(lines, LINE), 40.0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    # Cells are never broadcast, and the first reach follows the density.
    assert "BroadcastHashJoin" not in plan(got)
    assert spatial._first_reach(spark.createDataFrame(lines, LINE), 40.0) < 40.0


def test_nearest_line_names_ties(spark):
    lines = [(k, [(0.0, 0.0), (10.0, 0.0)], "B" if k == 30 else "A") for k in range(40)]
    frame = spark.createDataFrame([(1, 5.0, 1.0, "B"), (2, 5.0, 2.0, "C")], "addr_id bigint, x double, y double, name string")
    streets = spark.createDataFrame(lines, LINE + ", name string")
    got = spatial.nearest_line(frame, streets, 40.0, F.col("name") == F.col("line_name"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 30, 1.0), (2, 0, 2.0)]
    assert spatial._first_reach(streets, 40.0) < 40.0


def test_nearest_in_group(spark):
    rng = random.Random(4)
    at = lambda n, side: [(k, k % 3, float(rng.randrange(side)), float(rng.randrange(side))) for k in range(n)]
    points = at(150, 1000) + [(800, 7, 0.0, 0.0), (801, 7, 0.0, 0.0), (802, 9, 1.0, 1.0), (803, None, 1.0, 1.0)]
    places = at(90, 1000) + [(0, 7, 5000.0, 5000.0), (1, None, 1.0, 1.0)]
    want = {}
    for key, g, x, y in points:
        for _, h, px, py in places:
            if g == h and g is not None:
                want[g] = min(want.get(g, (math.inf, 0)), (round(math.dist((x, y), (px, py)), 6), key))
    schema = "addr_id bigint, grp bigint, x double, y double"
    got = spatial.nearest_in_group(spark.createDataFrame(points, schema), spark.createDataFrame(places, schema).drop("addr_id"), "grp", "addr_id")
    assert {r["grp"]: (r["dist"], r["addr_id"]) for r in got.collect()} == want


def test_points_with_rings(spark):
    rng = random.Random(5)
    points = [(k, float(rng.randrange(240)), rng.random() * 240) for k in range(300)] + [(900, None, 3.0), (901, 9999.0, 9999.0)]
    rings = random_rings(50, 200)
    frame, zones = spark.createDataFrame(points, "addr_id bigint, x double, y double"), spark.createDataFrame(rings, SQUARES)
    want = [(k, z) for k, x, y in points if x is not None for z, _, ring in rings if within(x, y, ring)]
    alone = [k for k, _, _ in points if k not in {p for p, _ in want}]
    got = spatial.points_with_rings(frame, zones, 30.0, outer=True)
    assert sorted((r["addr_id"], -1 if r["zone_id"] is None else r["zone_id"]) for r in got.collect()) == sorted(want + [(k, -1) for k in alone])
    # Points keep their columns on the way: no join of the many pairs with points or rings.
    labelled = spatial.left_points_in_rings(frame, zones, 30.0, "zone_name")
    assert "Join" not in plan(got) and "Join" not in plan(labelled)
    names = {z: name for z, name, _ in rings}
    assert sorted((r["addr_id"], r["zone_name"] or "") for r in labelled.collect()) == sorted([(k, names[z]) for k, z in want] + [(k, "") for k in alone])
    modal = spatial.modal(got.withColumn("g", F.col("addr_id") % 7), "g", "zone_name")
    count = {}
    for k, z in want:
        count.setdefault(k % 7, {}).setdefault(names[z], []).append(k)
    assert {r["g"]: r["zone_name"] for r in modal.collect()} == {g: min(c, key=lambda n: (-len(c[n]), n)) for g, c in count.items()}
    assert "Join" not in plan(modal)


def test_touching_forest(spark):
    # Few pairs connect what all pairs connect.
    lines = spark.createDataFrame(random_lines(300, 100), LINE)
    pairs, few = spatial.touching_lines(lines, 2.0), spatial.touching_forest(lines, 2.0)
    label = {k: k for k in range(300)}

    def find(k):
        return k if label[k] == k else find(label[k])

    def parts(rows):
        label.update({k: k for k in label})
        for a, b in rows:
            label[max(find(a), find(b))] = min(find(a), find(b))
        return {k: find(k) for k in label}

    every, some = [tuple(r) for r in pairs.collect()], [tuple(r) for r in few.collect()]
    assert {(min(p), max(p)) for p in some} <= set(every) and len(some) < len(every)
    assert parts(some) == parts(every)


def test_nearest_rest_comes_from_the_search():
    # What a search hasn't found it names itself, so that no table of found points is sent to all.
    edge = {"cx": 0, "cy": 0, "side": 0, "key": None, "line": 5, "_x": 0.0, "_y": 0.0, "_x2": 10.0, "_y2": 0.0}
    point = lambda key, x, y: {"cx": 0, "cy": 0, "side": 1, "key": key, "line": None, "_x": x, "_y": y, "_x2": None, "_y2": None}
    alone = point(3, 1.0, 2.0) | {"cx": 1}
    table = pa.Table.from_pylist([edge, point(1, 5.0, 1.0), point(2, 5.0, 7.0), alone])
    rows = [tuple(r) for out in tiles.nearest(4.0, True)(table) for r in zip(*(v.to_pylist() if hasattr(v, "to_pylist") else v.tolist() for v in out.values()))]
    assert sorted(rows) == [(1, 5, 1.0, False, None, None), (2, None, None, False, 5.0, 7.0), (3, None, None, False, 1.0, 2.0)]
    assert len(list(tiles.nearest(4.0)(table))) == 1


def test_nearest_line_searches_without_broadcasts(spark, monkeypatch, tmp_path):
    # Lines lie dense in one place and far apart elsewhere, so several searches are needed.
    seen, write = [], spatial.materialise
    monkeypatch.setattr(spatial, "materialise", lambda df, name: seen.append(plan(df)) or write(df, name))
    lines = random_lines(300, 60, points=(2, 3)) + [(900 + k, [(200.0 + 60 * k, 0.0), (200.0 + 60 * k, 50.0)]) for k in range(4)]
    rng = random.Random(6)
    points = [(k, float(rng.randrange(70)), float(rng.randrange(70))) for k in range(100)] + [(700 + k, 195.0 + 13 * k, 20.0) for k in range(15)] + [(715, 700.0, 700.0)]
    want = []
    for key, x, y in points:
        far = min((min(to_edge(x, y, a, b) for a, b in zip(line, line[1:])), k) for k, line in lines)
        want += [(key, far[1], far[0])] if far[0] <= 40.0 else []
    # Tables of Parquet, whose size Spark knows, would be broadcast.
    spark.createDataFrame(points, "addr_id bigint, x double, y double").withColumn("name", F.lit("A")).write.parquet(f"{tmp_path}/points")
    spark.createDataFrame(lines, LINE).withColumn("name", F.lit("A")).write.parquet(f"{tmp_path}/lines")
    frame, streets = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/lines")
    for match in (None, F.col("name") == F.col("line_name")):
        seen.clear()
        got = spatial.nearest_line(frame, streets, 40.0, match)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        assert len(seen) > 1 and not any("Join" in p for p in seen)
        assert "Broadcast" not in plan(got)


def test_scenario_summary_merges_its_lines(spark, tmp_path):
    near = spark.createDataFrame([(1, 10, 5.0), (2, 10, 50.0), (3, 11, 7.0)], "addr_id bigint, segment_id bigint, dist double")
    spark.createDataFrame([(10, 100.0), (11, 50.0)], "segment_id bigint, length double").write.parquet(f"{tmp_path}/lengths")
    lengths = spark.read.parquet(f"{tmp_path}/lengths")
    got = panel.scenario_summary(near, lengths, [10.0, 60.0], [1, 2])
    assert "Broadcast" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [("b10_m1", 2, 2, 75.0, 1.5), ("b60_m1", 2, 3, 75.0, 2.0), ("b60_m2", 1, 2, 100.0, 2.0)]


def test_overlap_stops_at_the_first_ring_that_holds_the_line(monkeypatch):
    # Many rings over one line: those after the first that holds it whole aren't looked at; a line that none holds whole meets them all.
    square = lambda x, y, w: [{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]
    ring = lambda k, shape: {"cx": 0, "cy": 0, "side": 0, "key": k, "ring": shape, "line": None, "pts": None}
    line = lambda k, *pts: {"cx": 0, "cy": 0, "side": 1, "key": None, "ring": None, "line": k, "pts": [{"x": x, "y": y} for x, y in pts]}
    rings = [ring(k, square(-5.0, -5.0, 8.0 if k < 20 else 20.0)) for k in range(2000)]
    seen, blocks = [], tiles.blocks
    monkeypatch.setattr(tiles, "blocks", lambda *a: (seen.append(len(p[0])) or p for p in blocks(*a)))

    def run(*lines):
        seen.clear()
        out = list(tiles.overlap(pa.Table.from_pylist([*rings, *lines])))
        return [r for o in out for r in zip(o["line"].to_pylist(), o["ring"].to_pylist(), o["overlap"].tolist())], sum(seen)

    assert run(line(1, (0.0, 0.0), (8.0, 0.0))) == ([(1, 20, 8.0)], 24)
    got, pairs = run(line(2, (14.0, 0.0), (24.0, 0.0)), line(3, (50.0, 50.0), (51.0, 50.0)), line(4, (0.0, 0.0), (1.0, 0.0)))
    assert got == [(2, 20, 1.0), (4, 0, 1.0)] and pairs == 4008
