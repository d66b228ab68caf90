"""Eligibility with history, seeded draws and allocations that don't depend on partitioning.

A draw orders the candidates by the SHA-256 of the seed, the stage and the key, and takes the first ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONDITIONAL, FIRST_DAY_RANDOM, WEEKLY_RANDOM, FROM_PREVIOUS, D2DS_RANDOM = 4, 20, 2, 4, 2


def draw_key(*parts: Column | str) -> Column:
    """A repeatable order key: the SHA-256 of the parts' texts joined by bars."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


def eligible(pool: DataFrame, hits: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows of the pool with a hit in the period and no use before: semi and anti joins, no row is multiplied."""
    return pool.join(hits.select(key).distinct(), key, "left_semi").join(used.select(key).distinct(), key, "left_anti")


def available(pool: DataFrame, used: DataFrame, exempt: DataFrame, key: str) -> DataFrame:
    """(key): the pool without used keys, but with those of it that are exempt."""
    keys = pool.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.join(used.select(key).distinct().join(exempt.select(key), key, "left_anti"), key, "left_anti")


def draw_per_group(df: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    """The ``k`` rows of each group that come first in the seeded order. Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy(group).orderBy(draw_key(seed, F.col(key)), key)
    return df.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= k)


def _first(pool: DataFrame, key: str, seed: str, stage: str, n: int) -> DataFrame:
    """(key, draw): at most ``n`` keys in the seeded order of a stage; a top-n of each task, then of those."""
    told = pool.select(key).distinct().select(key, draw_key(seed, stage, F.col(key)).alias("h")).orderBy("h", key).limit(n)
    return told.select(key, F.row_number().over(Window.orderBy("h", key)).cast("bigint").alias("draw"))


def draw_dh(eligible_keys: DataFrame, all_keys: DataFrame, first_day: bool, seed: str, key: str = "bundle_id") -> DataFrame:
    """(key, bundle_type, draw): the week's door-hanger bundles.

    Four conditional ones from the eligible keys and 20 (first day) or 2 random ones from all others. Too few eligible keys: all of them, and
    the missing ones are drawn at random as well; too few others: all of them.
    """
    n_random = FIRST_DAY_RANDOM if first_day else WEEKLY_RANDOM
    conditional = _first(eligible_keys, key, seed, "conditional", CONDITIONAL)
    others = _first(all_keys.join(conditional, key, "left_anti"), key, seed, "random", CONDITIONAL + n_random)
    # At most CONDITIONAL rows are counted and broadcast.
    spare = conditional.agg((F.lit(CONDITIONAL + n_random) - F.count("*")).alias("quota"))
    random = others.join(F.broadcast(spare), F.col("draw") <= F.col("quota")).drop("quota")
    return conditional.withColumn("bundle_type", F.lit("conditional")).unionByName(random.withColumn("bundle_type", F.lit("random")))


def draw_d2ds(previous_conditional: DataFrame, previous_all: DataFrame, eligible_keys: DataFrame, all_keys: DataFrame, seed: str, key: str = "bundle_id") -> DataFrame:
    """(key, bundle_type, draw): the week's survey bundles.

    Four from the previous week's door-hanger bundles, its conditional ones by id first and then its others at random; two at random,
    and one more for each of the four that is missing: from the eligible keys (from all keys if none is eligible), then from all keys.
    """
    rank = lambda df, p, h: df.select(key).distinct().select(key, F.lit(p).alias("p"), h.alias("h"))
    none = F.lpad(F.col(key).cast("string"), 20, "0")
    before = rank(previous_conditional, 0, none).union(rank(previous_all.join(previous_conditional, key, "left_anti"), 1, draw_key(seed, "fill", F.col(key))))
    order = Window.orderBy("p", "h", key)
    held = before.orderBy("p", "h", key).limit(FROM_PREVIOUS).withColumn("draw", F.row_number().over(order).cast("bigint"))
    rest_e, rest_a = eligible_keys.join(held, key, "left_anti"), all_keys.join(held, key, "left_anti")
    pool = rank(rest_e, 0, draw_key(seed, "random", F.col(key))).union(rank(rest_a.join(eligible_keys, key, "left_anti"), 1, draw_key(seed, "random", F.col(key))))
    others = pool.orderBy("p", "h", key).limit(FROM_PREVIOUS + D2DS_RANDOM).withColumn("draw", F.row_number().over(order).cast("bigint"))
    quota = held.agg((F.lit(FROM_PREVIOUS + D2DS_RANDOM) - F.count("*")).alias("quota"))
    random = others.join(F.broadcast(quota), F.col("draw") <= F.col("quota"))
    return held.select(key, F.lit("d2ds_conditional").alias("bundle_type"), "draw").union(random.select(key, F.lit("d2ds_random"), "draw"))


def day_one(all_keys: DataFrame, seed: str, workers: list[str], per_worker: int = 5, key: str = "bundle_id") -> DataFrame:
    """(key, interviewer, list_code): a uniform draw of ``per_worker`` keys for each worker, sorted and dealt out in blocks."""
    chosen = all_keys.select(key).distinct().select(key, draw_key(seed, "day1", F.col(key)).alias("h")).orderBy("h", key).limit(per_worker * len(workers))
    place = F.row_number().over(Window.orderBy(key)) - 1
    named = chosen.select(key, place.alias("place"))
    who = F.element_at(F.array(*map(F.lit, workers)), (F.floor(F.col("place") / per_worker) + 1).cast("int"))
    return named.select(key, who.alias("interviewer"), (F.col("place") % per_worker + 1).cast("int").alias("list_code"))


def arms(df: DataFrame, seed: str, *keys: str) -> DataFrame:
    """Assign Full, Partial or Control with chances of a quarter, a quarter and a half by the first hex digits of the seeded keys."""
    digits = F.substring(draw_key(seed, *map(F.col, keys)), 1, 8)
    arm = F.when(digits < "40000000", "Full").when(digits < "80000000", "Partial").otherwise("Control")
    return df.withColumn("dh_arm", arm).withColumn("treated_share", F.when(arm == "Full", 1.0).when(arm == "Partial", 0.5).otherwise(0.0))


def thin_segments(points: DataFrame, date: str) -> DataFrame:
    """``points`` with dh_treatment and dh_selected by segment: Full keeps all addresses, Partial half of them rounded down, Control none.

    An unknown or missing arm counts as Control. Addresses of a segment and interviewer are drawn in a seeded order.
    """
    arm = F.when(F.col("dh_arm").isin("Full", "Partial"), F.lower("dh_arm")).otherwise("control")
    group = Window.partitionBy("interviewer", "segment_id")
    order = draw_key(date, F.col("interviewer"), F.col("segment_id"), "DH", "partial", F.col("addr_id"))
    placed = points.withColumn("dh_treatment", arm).withColumn("_n", F.count("*").over(group)).withColumn("_k", F.row_number().over(group.orderBy(order, "addr_id")))
    kept = F.when(F.col("dh_treatment") == "full", True).when(F.col("dh_treatment") == "partial", F.col("_k") <= F.floor(F.col("_n") / 2)).otherwise(False)
    return placed.withColumn("dh_selected", kept).drop("_n", "_k")


def allocate_bundles(points: DataFrame, date: str, *group: str) -> DataFrame:
    """``points`` with dh_treatment and dh_selected by group: of each four addresses two are control, one is full and one partial.

    Of the remainder one is control; a second is full or partial by a seeded coin; three are one of each. Half of the
    partial ones, rounded down, are kept.
    """
    keys = [F.col(g) for g in group]
    order = draw_key(date, *keys, "DH", "treatment", F.col("addr_id"))
    w = Window.partitionBy(*group)
    rows = points.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(order, "addr_id")))
    q, k = F.floor(F.col("_n") / 4), F.col("_k")
    left = F.col("_n") - 4 * q
    coin = F.substring(draw_key(date, *keys, "DH", "coin"), 1, 1) < "8"
    second = F.when(left == 2, F.when(coin, "full").otherwise("partial")).otherwise("full")
    arm = F.when(k <= 2 * q, "control").when(k <= 3 * q, "full").when(k <= 4 * q, "partial").when(k == 4 * q + 1, "control").when(k == 4 * q + 2, second).otherwise("partial")
    rows = rows.withColumn("dh_treatment", arm)
    p = Window.partitionBy(*group, "dh_treatment")
    half = draw_key(date, *keys, "DH", "partial", F.col("addr_id"))
    rows = rows.withColumn("_m", F.count("*").over(p)).withColumn("_j", F.row_number().over(p.orderBy(half, "addr_id")))
    kept = F.when(F.col("dh_treatment") == "full", True).when(F.col("dh_treatment") == "partial", F.col("_j") <= F.floor(F.col("_m") / 2)).otherwise(False)
    return rows.withColumn("dh_selected", kept).drop("_n", "_k", "_m", "_j")


def bernoulli(df: DataFrame, p: Column, seed: str, *keys: str, name: str = "drawn") -> DataFrame:
    """``df`` with a seeded 0/1 draw of chance ``p`` for each row's keys; a null chance gives null."""
    uniform = F.conv(F.substring(draw_key(seed, *map(F.col, keys)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.withColumn(name, F.when(p.isNotNull(), (uniform < p).cast("int")))
