"""Spatial joins as equi-joins on grid cells with an exact test afterwards.

Every join covers its lines or rings with square cells and meets points or other lines only in equal cells, so work follows the number
of neighbours. Edges are covered one by one; a long line doesn't fill its whole bounding box. Null geometry joins nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kerbline.functions import geo
from kerbline.operators import tiles
from kerbline.runtime import materialise


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def _cover(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(_cell(low, size), _cell(high, size)))


def edge_cells(lines: DataFrame, key: str, line: str, size: float, reach: float) -> DataFrame:
    """(key, e, cx, cy): each edge of each line with the cells that its box, grown by ``reach``, touches."""
    e = F.col("e")
    rows = lines.select(key, F.explode(geo.edges(F.col(line))).alias("e"))
    rows = rows.select("*", _cover(F.least(e["x1"], e["x2"]) - reach, F.greatest(e["x1"], e["x2"]) + reach, size).alias("cx"))
    return rows.select("*", _cover(F.least(e["y1"], e["y2"]) - reach, F.greatest(e["y1"], e["y2"]) + reach, size).alias("cy"))


def near_lines(points: DataFrame, lines: DataFrame, max_dist: float, key: str = "addr_id", line_key: str = "segment_id") -> DataFrame:
    """(key, line_key, dist) of all lines within ``max_dist`` of each point (x, y)."""
    cells = edge_cells(lines, line_key, "line", max_dist, max_dist)
    at = points.select(key, "x", "y", _cell(F.col("x"), max_dist).alias("cx"), _cell(F.col("y"), max_dist).alias("cy"))
    # Cells are many more rows than their table's size tells, too many to be broadcast.
    met = at.join(cells.hint("merge"), ["cx", "cy"]).withColumn("dist", geo.point_to_edge(F.col("x"), F.col("y"), F.col("e"))).where(F.col("dist") <= max_dist)
    return met.groupBy(key, line_key).agg(F.min("dist").alias("dist"))


def _first_reach(lines: DataFrame, max_dist: float, crowd: int = 8) -> float:
    """``max_dist``, halved until a square of that width holds about ``crowd`` lines where most lines are."""
    p = geo.first_point(F.col("line"))
    cells = lines.groupBy(_cell(p["x"], max_dist).alias("cx"), _cell(p["y"], max_dist).alias("cy")).agg(F.count("*").cast("double").alias("n"))
    held = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    reach = max_dist
    while held > crowd and reach > max_dist / 4096:
        held, reach = held / 4, reach / 2
    return reach


def _nearest_within(points: DataFrame, lines: DataFrame, reach: float, key: str, line_key: str, rest: bool) -> DataFrame:
    """(key, line_key, dist, several, x, y): the lines at the least distance of each point within ``reach``; points lie in one tile, edges in all that they reach.

    With ``rest`` also the points that have none, told by a null distance, with their place.
    """
    size, e = 4 * reach, F.col("e")
    edges = edge_cells(lines, line_key, "line", size, reach * 1.001).select("cx", "cy", F.lit(0).alias("side"), F.col(line_key).alias("line"), e["x1"].alias("_x"), e["y1"].alias("_y"), e["x2"].alias("_x2"), e["y2"].alias("_y2"))
    at = points.where("x is not null and y is not null").select(_cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"), F.lit(1).alias("side"), F.col(key).alias("key"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    types = dict(points.dtypes) | {f"line {c}": t for c, t in lines.dtypes}
    got = tiles.stream(edges.unionByName(at, allowMissingColumns=True), ["side", "line"], tiles.nearest(reach, rest), f"key {types[key]}, line {types[f'line {line_key}']}, dist double, several boolean, x double, y double")
    return got.select(F.col("key").alias(key), F.col("line").alias(line_key), "dist", "several", "x", "y")


def nearest_line(points: DataFrame, lines: DataFrame, max_dist: float, match: Column | None = None, key: str = "addr_id", line_key: str = "segment_id") -> DataFrame:
    """(key, line_key, dist): the nearest line of each point within ``max_dist``; one row per point.

    Equal distances go to a line for which ``match`` (over the columns of both sides, the line's prefixed ``line_``) holds, then to the smaller
    line key. Points with no line in reach are absent.

    The search starts with a reach that suits the lines' density, and doubles it for the points that have found nothing; what is found within
    a reach is nearest. So work follows the number of points and lines, not of pairs within ``max_dist``. A search's table names those points
    itself, and tables are merged, never broadcast: keys in Parquet are far smaller than the rows that the driver would hold.
    """
    if match is not None:
        points, lines = points.where(F.col(key).isNotNull()), lines.where(F.col(line_key).isNotNull())
    reach, rest, found = _first_reach(lines, max_dist), points, []
    while True:
        last = reach >= max_dist
        got = _nearest_within(rest, lines, reach, key, line_key, not last)
        if match is not None or not last:
            got = materialise(got, "nearest")
        found.append(got.where("dist is not null").select(key, line_key, "dist", "several"))
        if last:
            break
        rest = got.where("dist is null").select(key, "x", "y")
        if rest.isEmpty():
            break
        reach = min(2 * reach, max_dist)
    near = reduce(DataFrame.union, found).withColumn("other", F.lit(True))
    if match is not None:
        # Only points with several nearest lines need the names.
        named = lines.select(*(F.col(c).alias(c if c == line_key else f"line_{c}") for c in lines.columns if c != "line"))
        tied = near.where("several").select(key, line_key, "dist").join(points.drop("x", "y").hint("merge"), key).join(named.hint("merge"), line_key)
        near = near.where("not several").select(key, line_key, "dist", "other").union(tied.select(key, line_key, "dist", (~F.coalesce(match, F.lit(False))).alias("other")))
    best = F.min(F.struct("dist", "other", line_key))
    return near.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{line_key}").alias(line_key), F.col("b.dist").alias("dist"))


def _ring_cells(rings: DataFrame, size: float, reach: float) -> DataFrame:
    """Rings with the cells (cx, cy) that their box, grown by ``reach``, touches."""
    b = F.col("_b")
    boxed = rings.withColumn("_b", geo.bounds(F.col("ring"))).withColumn("cx", _cover(b["x0"] - reach, b["x1"] + reach, size))
    return boxed.withColumn("cy", _cover(b["y0"] - reach, b["y1"] + reach, size)).drop("_b")


def points_with_rings(points: DataFrame, rings: DataFrame, size: float, outer: bool = False) -> DataFrame:
    """All columns of each point (x, y) with those but ``ring`` of each ring that holds it; with ``outer``, nulls for a point in none.

    A point lies in one tile, where all rings that can hold it come too, so its rows are whole without another join.
    """
    facts = rings.drop("ring")
    if set(points.columns) & set(facts.columns):
        raise ValueError("points and rings share names of columns")
    cells = _ring_cells(rings, size, 0.0).select("cx", "cy", F.lit(0).alias("side"), "ring", *(F.col(c).alias(f"r_{c}") for c in facts.columns))
    cell = lambda c: F.coalesce(_cell(F.col(c), size), F.lit(0)).alias(f"c{c}")
    at = points.select(cell("x"), cell("y"), F.lit(1).alias("side"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), *(F.col(c).alias(f"p_{c}") for c in points.columns))
    schema = StructType([StructField(f.name, f.dataType) for f in [*points.schema.fields, *facts.schema.fields]])
    kernel = tiles.holding(outer, [f"p_{c}" for c in points.columns], [f"r_{c}" for c in facts.columns], schema.names)
    return tiles.stream(cells.unionByName(at, allowMissingColumns=True), ["side"], kernel, schema)


def points_in_rings(points: DataFrame, rings: DataFrame, size: float, key: str = "addr_id", ring_key: str = "zone_id") -> DataFrame:
    """(key, ring_key) of all pairs of a point (x, y) and a ring that holds it; overlapping rings give several rows."""
    return points_with_rings(points.select(key, "x", "y"), rings.select(ring_key, "ring"), size).select(key, ring_key)


def left_points_in_rings(points: DataFrame, rings: DataFrame, size: float, label: str, key: str = "addr_id") -> DataFrame:
    """``points`` with the label of each ring that holds them, null for none; a point in two rings is two rows."""
    out = points_with_rings(points.drop(label), rings.select(label, "ring"), size, outer=True)
    return out.select(key, *(c for c in points.columns if c not in (key, label)), label)


def modal_label(members: DataFrame, labelled: DataFrame, group: str, key: str, label: str) -> DataFrame:
    """(group, label): the most frequent label among a group's labelled members, the smaller one on ties; null without any."""
    return modal(members.join(labelled, key, "left"), group, label)


def modal(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label): the most frequent label of each group's rows, the smaller one on ties; null where all are null."""
    counts = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    top = F.min(F.when(F.col(label).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(label))))
    return counts.groupBy(group).agg(top[label].alias(label))


def _inside_length(e: Column, ring: Column) -> Column:
    """Length of the part of an edge that lies in a ring: the edge is cut at the ring's edges and its pieces are tested at their middles."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]

    def cut(r: Column) -> Column:
        rx, ry = r["x2"] - r["x1"], r["y2"] - r["y1"]
        cross = dx * ry - dy * rx
        t = ((r["x1"] - e["x1"]) * ry - (r["y1"] - e["y1"]) * rx) / cross
        u = ((r["x1"] - e["x1"]) * dy - (r["y1"] - e["y1"]) * dx) / cross
        return F.when((cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    cuts = F.filter(F.transform(geo.edges(F.concat(ring, F.slice(ring, 1, 1))), cut), lambda t: t.isNotNull())
    ts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts))

    def piece(a: Column, b: Column) -> Column:
        middle = (a + b) / 2
        return F.when(geo.inside(e["x1"] + middle * dx, e["y1"] + middle * dy, ring), (b - a) * F.hypot(dx, dy)).otherwise(0.0)

    pieces = F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts) - 1), piece)
    return F.aggregate(pieces, F.lit(0.0), lambda s, p: s + p)


def largest_overlap(lines: DataFrame, rings: DataFrame, size: float, line_key: str = "segment_id", ring_key: str = "zone_id") -> DataFrame:
    """(line_key, ring_key, overlap): the ring that holds most of each line's length, the smaller key on ties; lines outside all rings are absent.

    A line no wider than half of ``size`` lies in a tile of that width, by its box's middle, and rings in all tiles from which such a line can reach them. Wider
    lines are compared with the rings of all cells that their edges touch.
    """
    b, size = geo.bounds(F.col("line")), size / 2
    boxed = lines.where(F.size("line") >= 2).select(F.col(line_key).alias("line"), F.col("line").alias("pts"), b.alias("b"))
    wide = F.greatest(F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")) > size
    middle = lambda c: _cell((F.col(f"b.{c}0") + F.col(f"b.{c}1")) / 2, size).alias(f"c{c}")
    at = boxed.where(~wide).select(middle("x"), middle("y"), F.lit(1).alias("side"), "line", "pts")
    cells = _ring_cells(rings.select(ring_key, "ring"), size, size * 0.501).select("cx", "cy", F.lit(0).alias("side"), F.col(ring_key).alias("key"), "ring")
    types = {"line": dict(lines.dtypes)[line_key], "ring": dict(rings.dtypes)[ring_key]}
    schema = f"line {types['line']}, ring {types['ring']}, overlap double"
    compact = tiles.stream(cells.unionByName(at, allowMissingColumns=True), ["side", "key"], tiles.overlap, schema)
    best = F.min(F.struct((-F.col("overlap")).alias("o"), F.col("ring")))
    found, broad = compact, boxed.where(wide).select("line", "pts")
    # Without wide lines their rings needn't be dealt out.
    if not broad.isEmpty():
        found = found.union(_wide_overlaps(broad, rings.select(F.col(ring_key).alias("key"), F.col("ring").alias("shape")), size))
    return found.groupBy("line").agg(best.alias("b")).select(F.col("line").alias(line_key), F.col("b.ring").alias(ring_key), (-F.col("b.o")).alias("overlap"))


def _wide_overlaps(lines: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(line, ring, overlap) of all pairs of a line and a ring that holds some of it."""
    pairs = edge_cells(lines, "line", "pts", size, 0.0).select("line", "cx", "cy").join(_ring_cells(rings.select("key", F.col("shape").alias("ring")), size, 0.0).drop("ring").hint("merge"), ["cx", "cy"])
    met = pairs.select("line", "key").distinct().join(lines, "line").join(rings, "key")
    inside = F.aggregate(geo.edges(F.col("pts")), F.lit(0.0), lambda s, e: s + _inside_length(e, F.col("shape")))
    return met.select("line", F.col("key").alias("ring"), inside.alias("overlap")).where("overlap > 0")


def _units(lines: DataFrame, reach: float, size: float, key: str) -> DataFrame:
    """(cx, cy, key, whole, pts, ux, uy): what touches is sought among, with the cells of its grown box and the first of them.

    A line of few edges in few cells is one unit; of others each edge is one.
    """
    grown = lambda d: d.withColumn("b", geo.bounds(F.col("pts"))).select("*", *(_cell(F.col(f"b.{c}{i}") + (2 * i - 1) * reach * 1.001, size).alias(f"{u}{c}") for c in "xy" for i, u in enumerate("uv"))).drop("b")
    rows = grown(lines.where(F.col(key).isNotNull() & (F.size("line") >= 2)).select(F.col(key).alias("key"), F.col("line").alias("pts")))
    whole = (F.size("pts") <= 9) & ((F.col("vx") - F.col("ux") + 1) * (F.col("vy") - F.col("uy") + 1) <= 16)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    e = F.col("e")
    parts = rows.where(~whole).select("key", F.explode(geo.edges(F.col("pts"))).alias("e")).select("key", F.array(point(e["x1"], e["y1"]), point(e["x2"], e["y2"])).alias("pts"))
    units = rows.where(whole).withColumn("whole", F.lit(True)).unionByName(grown(parts).withColumn("whole", F.lit(False)))
    return units.withColumn("cx", F.explode(F.sequence("ux", "vx"))).withColumn("cy", F.explode(F.sequence("uy", "vy"))).drop("vx", "vy")


def touching_lines(lines: DataFrame, reach: float, cell: float | None = None, key: str = "segment_id") -> DataFrame:
    """(src, dst), src < dst: pairs of lines no farther apart than twice ``reach``, as buffers of that width overlap.

    Two units meet in one tile only, so pairs of whole lines are distinct as they come.
    """
    units = _units(lines, reach, cell or max(4 * reach, 50.0), key)
    met = tiles.stream(units, [], tiles.touching(2 * reach), "src bigint, dst bigint, whole boolean")
    if lines.where(F.size("line") > 9).isEmpty() and units.where("not whole").isEmpty():
        return met.select("src", "dst")
    met = materialise(met, "touching")
    return met.where("whole").select("src", "dst").union(met.where("not whole").select("src", "dst").distinct())


def touching_forest(lines: DataFrame, reach: float, cell: float | None = None, key: str = "segment_id") -> DataFrame:
    """(src, dst) of some touching lines, which connect all that :func:`touching_lines` connects; as many rows as lines, not as pairs."""
    units = _units(lines, reach, cell or max(4 * reach, 50.0), key)
    return tiles.stream(units, [], tiles.forest(2 * reach), "src bigint, dst bigint")


def neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of undirected pairs."""
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def nearest_in_group(points: DataFrame, places: DataFrame, group: str, key: str, digits: int = 6) -> DataFrame:
    """(group, key, dist): each group's point (x, y) that lies nearest to one of its places (x, y), by rounded distances and then the smaller key.

    Points meet the places of the nine cells around them; cells start at a width that suits the places' number and double for the groups
    that have found nothing, so work doesn't follow the product of both sides.
    """
    usable = F.col(group).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    points = points.where(usable).groupBy(group, "x", "y").agg(F.min(key).alias(key))
    places = places.where(usable).select(group, "x", "y").distinct()
    box = [f(F.col(c)).alias(f"{n}{c}") for c in "xy" for n, f in (("least", F.min), ("most", F.max))]
    ends = points.select("x", "y").union(places.select("x", "y")).agg(*box).first()
    extent = max((ends["mostx"] or 0.0) - (ends["leastx"] or 0.0), (ends["mosty"] or 0.0) - (ends["leasty"] or 0.0), 1e-3)
    fullest = places.groupBy(group).count().agg(F.max("count")).first()[0] or 1
    cells = lambda rows, size: rows.withColumn("cx", _cell(F.col("x"), size)).withColumn("cy", _cell(F.col("y"), size))

    def crowd(size: float) -> float:
        count = lambda rows, n: cells(rows, size).groupBy(group, "cx", "cy").agg(F.count("*").cast("double").alias(n))
        row = count(points, "n").join(count(places, "m"), [group, "cx", "cy"], "full").agg(F.sum(F.col("n") * F.col("m")), F.sum("n"), F.sum("m")).first()
        return (row[0] or 0.0) / max((row[1] or 0.0) + (row[2] or 0.0), 1.0)

    size = extent / fullest**0.5
    while size > extent * 1e-9 and crowd(size) > 16:
        size /= 4
    found = []
    while True:
        around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
        at = cells(points, size).select(group, key, "x", "y", around("cx"), "cy").select(group, key, "x", "y", "cx", around("cy"))
        near = cells(places, size).select(group, F.col("x").alias("_x"), F.col("y").alias("_y"), "cx", "cy").hint("merge")
        dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
        met = at.join(near, [group, "cx", "cy"]).select(group, F.struct(F.round(F.sqrt(dx * dx + dy * dy), digits).alias("dist"), F.col(key)).alias("b"))
        got = met.groupBy(group).agg(F.min("b").alias("b")).select(group, f"b.{key}", "b.dist")
        # Beyond a cell's width a nearer place may lie outside the nine cells; the last digit leaves room for rounding.
        if size <= extent:
            got = got.where(F.col("dist") < size - 10.0**-digits)
        got = materialise(got, "nearest-in-group")
        found.append(got)
        points = points.join(got.select(group), group, "left_anti")
        places = places.join(got.select(group), group, "left_anti")
        if size > extent or points.join(places.select(group).distinct(), group, "left_semi").isEmpty():
            return reduce(DataFrame.union, found)
        size *= 2


def clip_to_extent(rings: DataFrame, lines: DataFrame, margin: float) -> DataFrame:
    """Rings whose box meets the lines' common box grown by ``margin``; the box is one row."""
    b = geo.bounds(F.col("line"))
    box = lines.select(b.alias("b")).agg(*(f(F.col(f"b.{c}")).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    r = geo.bounds(F.col("ring"))
    meets = (r["x1"] >= F.col("x0") - margin) & (r["x0"] <= F.col("x1") + margin) & (r["y1"] >= F.col("y0") - margin) & (r["y0"] <= F.col("y1") + margin)
    return rings.join(F.broadcast(box), meets).select(*rings.columns)


def cost_matrix(workers: DataFrame, bundles: DataFrame) -> DataFrame:
    """(name, bundle_id, km) of every located worker and bundle of a plan: workers are a crew of a few, and are broadcast."""
    crew = F.broadcast(workers.select("name", F.col("lat").alias("wlat"), F.col("lon").alias("wlon")).where("wlat is not null and wlon is not null"))
    return bundles.select("bundle_id", "lat", "lon").crossJoin(crew).select("name", "bundle_id", geo.haversine_km(F.col("wlat"), F.col("wlon"), F.col("lat"), F.col("lon")).alias("km"))
