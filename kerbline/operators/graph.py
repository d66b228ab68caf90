"""Graph operators that stay relational at any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.runtime import materialise, release

#: Edges that one task contracts to the end; more go through rounds.
TOGETHER = 1 << 18


def _contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars: connected as before, with at most one edge for each vertex that the partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                low, high = sorted((find(a), find(b)))
                parent[high] = low
        pairs = [(x, top) for x in parent if (top := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["src", "dst"])

    return edges.mapInArrow(run, "src bigint, dst bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
    return both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(low, "src").where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(low.select("src", F.col("m").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): each vertex of ``edges(src, dst)`` with the smallest vertex of its component.

    A round contracts the edges inside each partition and then applies the large-star and small-star rewrites, until the edge
    set is a forest of stars, or ``TOGETHER`` edges at most are left, which one task contracts to stars. So no task ever holds more, however
    many vertices a component has, and the number of rounds grows with the logarithm of the longest path between partitions. Each round is
    written to the shared scratch folder.
    Self loops and edges with a null end are ignored; vertices without an edge do not occur in the result.
    """
    cur = edges.select(F.greatest("src", "dst").cast("bigint").alias("src"), F.least("src", "dst").cast("bigint").alias("dst"))
    cur = cur.where(edges["src"].isNotNull() & edges["dst"].isNotNull()).where("src != dst")
    cur, seen = materialise(_contract(cur), "components"), None
    for _ in range(max_rounds):
        now, last = _state(cur), cur
        if now[0] <= TOGETHER:
            cur = materialise(_contract(cur.coalesce(1)), "components")
            release(last)
            break
        if now == seen:
            break
        seen = now
        # Small-star wants the larger end first, as contraction and large-star leave it.
        cur = materialise(_small_star(_large_star(_contract(cur))), "components")
        release(last)
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return cur.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
