"""Bundles of walkable street segments: adjacency and components relationally, growth and walks per component or bundle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import network
from kerbline.operators.graph import connected_components
from kerbline.operators.spatial import neighbours, touching_forest, touching_lines
from kerbline.runtime import materialise

_SEGMENT = "segment_id bigint, component_id bigint, n bigint, x double, y double, a string, b string, length double, nbrs array<bigint>"


def segment_facts(segments: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(segment_id, n, x, y, a, b, length) of segments (segment_id, line, n): middle, snapped ends and length; lines of fewer than two points are dropped."""
    m = geo.moments(F.col("line"))
    rows = segments.where(F.size("line") >= 2).withColumn("_m", m)
    middle = lambda c: F.when(F.col("_m.l") > 0, F.col(f"_m.m{c}") / F.col("_m.l")).otherwise(geo.first_point(F.col("line"))[c]).alias(c)
    return rows.select("segment_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), middle("x"), middle("y"), geo.node(geo.first_point(F.col("line")), tolerance).alias("a"), geo.node(geo.last_point(F.col("line")), tolerance).alias("b"), F.col("_m.l").alias("length"))


def network_components(segments: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(segment_id, component_id) and the touching pairs of all segments; a segment that touches none is its own component."""
    lines = segments.select("segment_id", "line")
    pairs, found = touching_lines(lines, reach), connected_components(touching_forest(lines, reach))
    named = segments.select("segment_id").join(found.withColumnRenamed("node", "segment_id"), "segment_id", "left")
    return named.select("segment_id", F.coalesce("component", "segment_id").alias("component_id")), pairs


def component_table(segments: DataFrame, reach: float = 1.0, tolerance: float = 0.5) -> DataFrame:
    """All that bundling needs of each segment, with its component and neighbours."""
    named, pairs = network_components(segments, reach)
    near = neighbours(pairs).groupBy(F.col("src").alias("segment_id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    rows = segment_facts(segments, tolerance).join(named, "segment_id").join(near, "segment_id", "left")
    return rows.select("segment_id", "component_id", "n", "x", "y", "a", "b", "length", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def to_network(rows: pd.DataFrame) -> network.Network:
    rows = rows.sort_values("segment_id")
    place = {s: i for i, s in enumerate(rows["segment_id"])}
    pairs = {(min(i, j), max(i, j)) for s, near in zip(rows["segment_id"], rows["nbrs"]) for i, j in ((place[s], place[d]) for d in near if d in place) if i != j}
    return network.Network(rows["segment_id"], rows["n"], rows[["x", "y"]].to_numpy(), zip(rows["a"], rows["b"]), rows["length"], pairs)


def bundle_segments(table: DataFrame, target: int, method: str = "balanced", seed: int = 42, multiplier: float = 1.2, least: int | None = None) -> DataFrame:
    """(segment_id, component_id, bundle_id, bundle_addr_total, bundle_seg_count) of the rows of :func:`component_table`.

    A task holds one component, a connected street network. Bundle numbers are dense over (component, number in it). Segments that
    no step places have a null bundle.
    """
    steps = {"greedy": lambda net: network.greedy_bundles(net, target, seed, least), "balanced": lambda net: network.balanced_bundles(net, target, seed, multiplier, least)}
    solve = steps[method]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        net = to_network(rows)
        own = pd.Series(solve(net), dtype="Int64")
        return pd.DataFrame({"segment_id": net.ids, "component_id": rows["component_id"].iloc[0], "n": net.counts, "own": own})

    grown = table.groupBy("component_id").applyInPandas(run, "segment_id bigint, component_id bigint, n bigint, own bigint")
    return number_bundles(materialise(grown, "bundles"))


def number_bundles(grown: DataFrame) -> DataFrame:
    """Global bundle numbers of (component_id, own), with totals; the numbering sorts bundles, not segments."""
    sums = grown.where("own is not null").groupBy("component_id", "own").agg(F.sum("n").alias("bundle_addr_total"), F.count("*").alias("bundle_seg_count"))
    per = sums.groupBy("component_id").agg(F.count("*").alias("k"))
    base = per.withColumn("base", F.coalesce(F.sum("k").over(Window.orderBy("component_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    local = F.row_number().over(Window.partitionBy("component_id").orderBy("own")) - 1
    named = sums.withColumn("_at", local).join(base, "component_id").withColumn("bundle_id", F.col("base") + F.col("_at")).drop("_at", "base")
    return grown.join(named, ["component_id", "own"], "left").select("segment_id", "component_id", "n", "bundle_id", "bundle_addr_total", "bundle_seg_count")


def endpoint_index(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(bundle_id, node) of the distinct snapped ends of each bundle's segments."""
    rows = members.where("bundle_id is not null").select("segment_id", "bundle_id").join(facts, "segment_id")
    return rows.select("bundle_id", F.explode(F.array("a", "b")).alias("node")).distinct()


def node_degrees(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(bundle_id, node, degree): how many ends of the bundle's segments meet at each node."""
    rows = members.where("bundle_id is not null").select("segment_id", "bundle_id").join(facts, "segment_id")
    return rows.select("bundle_id", F.explode(F.array("a", "b")).alias("node")).groupBy("bundle_id", "node").agg(F.count("*").alias("degree"))


def odd_counts(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(bundle_id, nodes, odd_nodes)."""
    return node_degrees(members, facts).groupBy("bundle_id").agg(F.count("*").alias("nodes"), F.sum(F.col("degree") % 2).alias("odd_nodes"))


def connected_bundles(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(bundle_id, pieces, connected): components of each bundle's graph of snapped ends, for all bundles in one pass.

    Bundle and node together name a vertex, so one run of the component search serves all bundles.
    """
    rows = members.where("bundle_id is not null").select("segment_id", "bundle_id").join(facts, "segment_id")
    vertex = lambda c: F.xxhash64("bundle_id", c)
    found = connected_components(rows.select(vertex("a").alias("src"), vertex("b").alias("dst")))
    ends = rows.select("bundle_id", F.explode(F.array(vertex("a"), vertex("b"))).alias("node")).distinct()
    named = ends.join(found, "node", "left").select("bundle_id", F.coalesce("component", "node").alias("c"))
    return named.groupBy("bundle_id").agg(F.count_distinct("c").alias("pieces")).withColumn("connected", F.col("pieces") == 1)


def walks(members: DataFrame, table: DataFrame) -> DataFrame:
    """(bundle_id, seq, segment_id, reversed, start_flag): a walk over each connected bundle; bundles that don't hang together give none."""
    rows = members.where("bundle_id is not null").select("segment_id", "bundle_id").join(table, "segment_id")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        net = to_network(part)
        try:
            steps = network.walk(net, list(range(len(net))))
        except ValueError:
            steps = []
        return pd.DataFrame({"bundle_id": part["bundle_id"].iloc[0], "seq": np.arange(1, len(steps) + 1), "segment_id": [net.ids[i] for i, _ in steps], "reversed": [back for _, back in steps], "start_flag": [int(k == 0) for k in range(len(steps))]}).astype({"segment_id": "int64", "seq": "int64"})

    return rows.groupBy("bundle_id").applyInPandas(run, "bundle_id bigint, seq bigint, segment_id bigint, reversed boolean, start_flag int")


def walk_tests(members: DataFrame, table: DataFrame) -> DataFrame:
    """(bundle_id, walkable, odd_before, odd_after, repeated) of each bundle."""
    rows = members.where("bundle_id is not null").select("segment_id", "bundle_id").join(table, "segment_id")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        net = to_network(part)
        held = list(range(len(net)))
        ok, before, after = network.walkable(net, held)
        return pd.DataFrame({"bundle_id": [part["bundle_id"].iloc[0]], "walkable": [ok], "odd_before": [before], "odd_after": [after], "repeated": [network.pair_odd_nodes(net, held)[0] if ok else None]})

    return rows.groupBy("bundle_id").applyInPandas(run, "bundle_id bigint, walkable boolean, odd_before int, odd_after int, repeated double")


def centroids(members: DataFrame, segments: DataFrame) -> DataFrame:
    """(bundle_id, x, y, km): centroid of each bundle's lines weighted by length, and their length in km."""
    rows = members.where("bundle_id is not null").select("segment_id", "bundle_id").join(segments.select("segment_id", geo.moments(F.col("line")).alias("m")), "segment_id")
    sums = rows.groupBy("bundle_id").agg(F.sum("m.l").alias("l"), F.sum("m.mx").alias("mx"), F.sum("m.my").alias("my"))
    return sums.select("bundle_id", F.try_divide("mx", "l").alias("x"), F.try_divide("my", "l").alias("y"), (F.col("l") / 1000).alias("km"))
