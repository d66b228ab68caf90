"""Exact top-k search over binary codes by incremental multi-index hashing.

An embedding's code has one sign bit per dimension, in words of ``WORD`` bits and segments of ``BITS``. Within a shard of the distinct codes each segment
has its own index; a query's segment search radius grows step by step until the k-th verified Hamming distance is
provably covered: after all segments are searched to radius r, every code within (r + 1) bits for each segment, less one, has been seen.
Exact shard results merge to the exact result.

Equal codes are one index entry that holds its k + 1 smallest ids, which is enough for any exact answer, so a hot code costs no more
than another. Queries (a stated set of rows) meet the index in blocks of about ``BLOCK_CODES`` codes: each query code goes once to each shard, so
the work is that of queries times shards, each visit far below a scan. Vectors of different lengths are searched apart.
A row is not its own neighbour; ties in distance go to the smaller id. Null ids and null, empty or null-holding vectors are left out;
repeated ids count once, with their smallest code of the shortest vector. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.runtime import materialise

WORD, BITS, SHARD_CODES, BLOCK_CODES = 64, 16, 50_000, 4_096


def code_column(vector: str = "embedding") -> Column:
    """The sign bits of all dimensions as an array of longs; a positive value sets the bit."""

    def word(at: Column) -> Column:
        one = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(F.transform(F.slice(F.col(vector), at * WORD + 1, F.lit(WORD)), one), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / WORD).cast("int")), word)


@lru_cache(maxsize=BITS + 1)
def masks(radius: int) -> np.ndarray:
    """All segment values of ``radius`` set bits."""
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(BITS), radius)], np.int64)


class MultiIndex:
    """Segment tables of one shard of distinct codes, one row of words each, with their numbers of ids."""

    def __init__(self, codes: np.ndarray, weight: np.ndarray, width: int):
        self.codes, self.weight, self.width = codes.view(np.uint64), weight, width
        self.tables = []
        for s in range(-(-width // BITS)):
            value = self._segment(self.codes, s)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << BITS) + 1))))

    @staticmethod
    def _segment(codes, s: int):
        word, at = divmod(BITS * s, WORD)
        return (codes[..., word] >> np.uint64(at)).astype(np.int64) & ((1 << BITS) - 1)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of all codes up to the distance that covers k ids."""
        q = query.view(np.uint64)
        seen, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(BITS + 1):
            fresh = []
            for s, (order, start) in enumerate(self.tables):
                value = masks(radius) ^ self._segment(q, s)
                lo, hi = start[value], start[value + 1]
                n = hi - lo
                fresh.append(order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
            new = np.setdiff1d(np.concatenate(fresh), seen)
            seen = np.append(seen, new)
            dist = np.append(dist, np.bitwise_count(self.codes[new] ^ q).sum(axis=1, dtype=np.int64))
            covered = len(self.tables) * (radius + 1) - 1
            if self.weight[seen[dist <= covered]].sum() >= k or len(seen) == len(self.codes):
                break
        per = np.bincount(dist, self.weight[seen], minlength=self.width + 1)
        bound = int(np.searchsorted(np.cumsum(per), k))
        near = dist <= bound
        return seen[near], dist[near]


def top_k(df: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance) of each query row against all rows."""
    sized = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sized = sized.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    coded = sized.select("id", "asks", F.size("v").alias("width"), code_column("v").alias("code"))
    coded = materialise(coded.groupBy("id").agg(F.max("asks").alias("asks"), F.min(F.struct("width", "code")).alias("c")).select("id", "asks", "c.*"), "hamming-codes")
    # The smallest ids of a code, found in two steps so that no task holds all ids of a hot code.
    salted = coded.select("width", "code", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    w1 = salted.selectExpr("width", "code", "id", "row_number() over (partition by width, code, salt order by id) as n").where(F.col("n") <= k + 1)
    kept = w1.selectExpr("width", "code", "id", "row_number() over (partition by width, code order by id) as n").where(F.col("n") <= k + 1)
    entries = materialise(kept.groupBy("width", "code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "hamming-entries")
    shards = max(1, -(-entries.count() // SHARD_CODES))
    index = entries.select("width", F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard"), "code", "ids")
    asked = coded.where("asks").select("width", "code").distinct().select("width", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"), "code")
    # Blocks of queries keep a task's share bounded; the shard's index is dealt to each block.
    blocks = max(8, -(-coded.where("asks").select("width", "code").distinct().count() // BLOCK_CODES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def find(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(held):
            return pd.DataFrame({"width": [], "code": [], "distance": [], "id": []}).astype({"width": "int32", "code": object, "distance": "int64", "id": "int64"})
        width = int(held["width"].iloc[0])
        ids = held["ids"].to_numpy()
        tables = MultiIndex(np.stack(held["code"].to_list()).astype(np.int64), np.array([len(x) for x in ids]), width)
        codes, out = [], []
        for q in wanted["code"]:
            at, dist = tables.search(np.asarray(q, np.int64), k + 1)
            n = tables.weight[at]
            found = np.stack([np.repeat(dist, n), np.concatenate([ids[i] for i in at])])
            found = found[:, np.lexsort((found[1], found[0]))[: k + 1]]
            codes += [q] * found.shape[1]
            out.append(found)
        distance, found_id = np.concatenate(out, 1)
        return pd.DataFrame({"width": width, "code": codes, "distance": distance, "id": found_id})

    local = asked.groupBy("width", "shard", "block").cogroup(index.groupBy("width", "shard", "block")).applyInPandas(find, "width int, code array<bigint>, distance bigint, id bigint")
    best = local.selectExpr("width", "code", "distance", "id", "row_number() over (partition by width, code order by distance, id) as n").where(F.col("n") <= k + 1).drop("n")
    answers = coded.where("asks").select(F.col("id").alias("query_id"), "width", "code").join(best, ["width", "code"]).where("id != query_id")
    ranked = answers.selectExpr("query_id", "row_number() over (partition by query_id order by distance, id) as rank", "id as neighbour_id", "distance")
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
