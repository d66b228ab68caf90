"""Bundle sizes, two-sample balance, overlap and quality labels."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ARMS = ("Full", "Partial")


def totals(members: DataFrame, group: str, value: str) -> DataFrame:
    """(group, total, n): sum and number of non-null values; rows without a group are dropped."""
    return members.where(F.col(group).isNotNull()).groupBy(group).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def size_metrics(bundles: DataFrame, size: str, segments: str | None = None) -> DataFrame:
    """One row of spread measures of bundle sizes; variances are those of the population, percentiles interpolate.

    Sizes are counted by value first, so the exact percentiles and the second pass over deviations see each distinct size once.
    ``segments`` is the column of each bundle's segment count, for the singleton measures. An empty table gives counts of 0 and nulls.
    """
    counted = bundles.where(F.col(size).isNotNull()).groupBy(F.col(size).cast("double").alias("s")).agg(F.count("*").alias("w"))
    part = lambda p: F.percentile("s", F.lit(p), F.col("w"))
    n, total = F.sum("w"), F.sum(F.col("s") * F.col("w"))
    base = counted.agg(
        F.coalesce(n, F.lit(0)).alias("n_bundles"), total.alias("total"), part(0.5).alias("median"), F.min("s").alias("smallest"), F.max("s").alias("largest"),
        part(0.25).alias("p25"), part(0.75).alias("p75"),
    ).withColumn("mean", F.try_divide("total", "n_bundles"))
    base = base.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("range", F.col("largest") - F.col("smallest")).withColumn("ratio", F.expr("try_divide(largest, nullif(smallest, 0))"))
    dev = F.abs(F.col("s") - F.col("mean"))
    out = (F.col("s") < F.col("p25") - 1.5 * F.col("iqr")) | (F.col("s") > F.col("p75") + 1.5 * F.col("iqr"))
    spread = counted.join(F.broadcast(base), how="cross").agg(
        F.sqrt(F.try_divide(F.sum(F.col("w") * dev * dev), F.sum("w"))).alias("std"), F.try_divide(F.sum(F.col("w") * dev), F.sum("w")).alias("mad"),
        F.coalesce(F.sum(F.when(out, F.col("w")).otherwise(0)), F.lit(0)).alias("n_outliers"),
    )
    row = base.crossJoin(F.broadcast(spread)).withColumn("cv", F.try_divide("std", "mean")).withColumn("masd", F.try_divide("mad", "mean"))
    row = row.withColumn("outlier_share", F.try_divide(F.col("n_outliers").cast("double"), "n_bundles"))
    if segments is not None:
        single = bundles.agg(F.count_if(F.col(segments) == 1).alias("n_singletons"), F.avg(segments).alias("mean_segments"))
        row = row.crossJoin(F.broadcast(single)).withColumn("singleton_share", F.try_divide(F.col("n_singletons").cast("double"), "n_bundles"))
    return row


def hard_limit_metrics(bundles: DataFrame, size: str, target: float, multiplier: float) -> DataFrame:
    """One row: the hard maximum int(target * multiplier), how many bundles exceed it, their share, and deviations from the target."""
    most = int(target * multiplier)
    over = F.col(size) > most
    row = bundles.where(F.col(size).isNotNull()).agg(
        F.count("*").alias("n_bundles"), F.count_if(over).alias("violations"), F.max(size).alias("largest"), F.max(F.abs(F.col(size) - target)).alias("max_deviation"),
        F.avg(F.abs(F.col(size) - target)).alias("mean_deviation"), F.count_if(F.col(size).between(0.9 * target, 1.1 * target)).alias("n_in_band"),
    )
    row = row.withColumn("hard_max", F.lit(most)).withColumn("violation_share", F.try_divide(F.col("violations").cast("double"), "n_bundles"))
    return row.withColumn("max_deviation_pct", F.col("max_deviation") / F.lit(float(target)) * 100)


def _beta_share(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    out = np.empty(len(x))
    for i, (p, y) in enumerate(zip(a, x)):
        q, flip = b, y > (p + 1) / (p + b + 2)
        if flip:
            p, q, y = b, p, 1 - y
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p if 0 < y < 1 else 0.0
        tiny, c, d = 1e-300, 1.0, 1 - (p + q) * y / (p + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + step * d
                c = 1 + step / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        out[i] = 1 - front * h if flip else front * h
    return out


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t; called on one row per variable."""
    known = (t.notna() & df.notna() & (df > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    v, s = df.to_numpy(float)[known], t.to_numpy(float)[known]
    out[known] = _beta_share(v / 2, 0.5, v / (v + s * s))
    return pd.Series(out).where(known, None)


def two_sample(df: DataFrame, first: Column, value: str, by: str | None = None) -> DataFrame:
    """Welch statistics of ``value`` between the rows where ``first`` holds and the others, per value of ``by`` if stated.

    Nulls and NaN are left out. The standardised difference uses population variances and is 0 where both are 0; t, its degrees
    of freedom and p use sample variances and are null where these can't be had. If a group is empty all but the counts are null.
    """
    rows = df.where(first.isNotNull()).withColumn("_v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
    a, b = F.when(first, F.col("_v")), F.when(~first, F.col("_v"))
    aggs = [f(x).alias(f"{n}{k}") for x, k in ((a, 1), (b, 2)) for f, n in ((F.avg, "mean"), (F.count, "n"), (F.var_pop, "pop"), (F.var_samp, "var"))]
    m = rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)
    diff, both = F.col("mean1") - F.col("mean2"), (F.col("n1") > 0) & (F.col("n2") > 0)
    pooled = F.sqrt((F.col("pop1") + F.col("pop2")) / 2)
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    dof = F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    out = m.select(
        *([by] if by else []), F.when(both, F.col("mean1")).alias("group1_mean"), F.col("n1").alias("group1_n"), F.when(both, F.col("mean2")).alias("group2_mean"), F.col("n2").alias("group2_n"),
        diff.alias("difference"), F.when(both, F.when(pooled > 0, diff / pooled).otherwise(0.0)).alias("std_diff"),
        F.when((F.col("n1") > 1) & (F.col("n2") > 1), F.try_divide(diff, F.sqrt(e1 + e2))).alias("t_stat"), F.when((F.col("n1") > 1) & (F.col("n2") > 1), dof).alias("dof"),
    )
    return out


def with_p(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p_value", student_p("t_stat", "dof"))


def _compare(rows: DataFrame, first: Column, covariates: list[str], comparison: str, label1: str, label2: str) -> DataFrame:
    """Balance rows of all covariates in one aggregate over the unpivoted table."""
    long = rows.withColumn("_first", first).unpivot(["_first"], [F.col(c).cast("double").alias(c) for c in covariates], "variable", "value")
    out = two_sample(long, F.col("_first"), "value", "variable")
    return out.withColumn("comparison", F.lit(comparison)).withColumn("group1_label", F.lit(label1)).withColumn("group2_label", F.lit(label2))


def treated_against_control(segments: DataFrame, assigned: DataFrame, covariates: list[str]) -> DataFrame:
    """Level 1: treated (full or partial) against control segments over all assigned segments."""
    rows = segments.join(assigned.select("segment_id", F.col("dh_arm").isin(*ARMS).alias("treated")).distinct(), "segment_id")
    return _compare(rows, F.col("treated"), covariates, "treatment_vs_control", "treated", "control")


def treated_in_survey(segments: DataFrame, assigned: DataFrame, dh: DataFrame, d2ds: DataFrame, covariates: list[str]) -> DataFrame:
    """Level 2: the same among the segments of bundles in both tasks."""
    both = dh.select("bundle_id").intersect(d2ds.select("bundle_id"))
    rows = segments.join(both, "bundle_id", "left_semi").join(assigned.select("segment_id", F.col("dh_arm").isin(*ARMS).alias("treated")).distinct(), "segment_id")
    return _compare(rows, F.col("treated"), covariates, "survey_sample", "treated", "control")


def surveyed_against_rest(segments: DataFrame, dh: DataFrame, d2ds: DataFrame, covariates: list[str]) -> DataFrame:
    """Level 3: surveyed segments against the others among used bundles."""
    marked = d2ds.select("bundle_id").distinct().withColumn("surveyed", F.lit(True))
    used = dh.select("bundle_id").union(d2ds.select("bundle_id")).distinct()
    rows = segments.join(used, "bundle_id", "left_semi").join(marked, "bundle_id", "left").withColumn("surveyed", F.coalesce("surveyed", F.lit(False)))
    return _compare(rows, F.col("surveyed"), covariates, "survey_representativeness", "d2ds", "not_d2ds")


def all_levels(segments: DataFrame, assigned: DataFrame, dh: DataFrame, d2ds: DataFrame, covariates: list[str]) -> DataFrame:
    """The three levels in one table with a fixed column order."""
    parts = [treated_against_control(segments, assigned, covariates), treated_in_survey(segments, assigned, dh, d2ds, covariates), surveyed_against_rest(segments, dh, d2ds, covariates)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("comparison", "variable", "group1_label", "group1_mean", "group1_n", "group2_label", "group2_mean", "group2_n", "difference", "std_diff", "t_stat", "dof")


def overlap(members: DataFrame, plan: DataFrame, size: str = "n_addresses") -> DataFrame:
    """(category, bundles, segments, addresses, pct_of_bundles, pct_of_segments, pct_of_addresses) of the bundle pool by use.

    Categories are DH only, D2DS only, Both DH & D2DS, Never used and Total (used); percentages of the whole pool have one digit.
    """
    task = F.upper(F.trim("task"))
    use = plan.where("bundle_id is not null").groupBy("bundle_id").agg(F.bool_or(F.coalesce(task == "DH", F.lit(False))).alias("dh"), F.bool_or(F.coalesce(task == "D2DS", F.lit(False))).alias("d2ds"))
    pool = members.where("bundle_id is not null").groupBy("bundle_id").agg(F.count_distinct("segment_id").alias("segments"), F.coalesce(F.sum(size), F.lit(0)).alias("addresses"))
    named = pool.join(use, "bundle_id", "left")
    kind = F.when(F.col("dh") & F.col("d2ds"), "Both DH & D2DS").when(F.col("dh"), "DH only").when(F.col("d2ds"), "D2DS only").otherwise("Never used")
    sums = lambda d, *by: d.groupBy(*by).agg(F.count("*").alias("bundles"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"), F.coalesce(F.sum("addresses"), F.lit(0)).alias("addresses"))
    found = sums(named.withColumn("category", kind), "category")
    used = sums(named.where("dh or d2ds")).select(F.lit("Total (used)").alias("category"), "bundles", "segments", "addresses")
    whole = found.agg(F.sum("bundles").alias("b"), F.sum("segments").alias("s"), F.sum("addresses").alias("a"))
    pct = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), F.col(y)) * 100, 1)
    out = found.unionByName(used).crossJoin(F.broadcast(whole))
    return out.select("category", "bundles", "segments", "addresses", pct("bundles", "b").alias("pct_of_bundles"), pct("segments", "s").alias("pct_of_segments"), pct("addresses", "a").alias("pct_of_addresses"))


def quality_label(cv: Column) -> Column:
    """Verbal grade of a coefficient of variation."""
    return F.when(cv < 0.10, "excellent").when(cv < 0.15, "good").when(cv < 0.20, "acceptable").when(cv < 0.30, "fair").otherwise("poor")


def quality_report(metrics: DataFrame) -> DataFrame:
    """``metrics`` of :func:`size_metrics` with verbal grades and the recommendation whether to balance again."""
    masd = F.col("masd")
    single = F.col("singleton_share")
    out = metrics.withColumn("cv_label", quality_label(F.col("cv")))
    out = out.withColumn("masd_label", F.when(masd < 0.10, "excellent").when(masd < 0.15, "good").when(masd < 0.20, "acceptable").otherwise("poor"))
    if "singleton_share" in metrics.columns:
        out = out.withColumn("singleton_label", F.when(single < 0.02, "excellent").when(single < 0.05, "good").when(single < 0.10, "acceptable").otherwise("poor"))
    return out.withColumn("rebalance", F.coalesce((F.col("cv") > 0.25) | (F.col("ratio") > 3), F.lit(False)))


def infer_arms(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """(segment_id, n_treated, total, share, dh_arm): the arm that the share of treated addresses speaks for."""
    n = points.where("segment_id is not null").groupBy("segment_id").agg(F.count("*").alias("n_treated"))
    rows = sizes.join(n, "segment_id", "left").withColumn("n_treated", F.coalesce("n_treated", F.lit(0)))
    share = F.try_divide(F.col("n_treated").cast("double"), F.col("total"))
    s = F.col("share")
    arm = F.when(s >= 0.9, "Full").when(s.between(0.4, 0.6), "Partial").when(s < 0.1, "Control").when(s > 0.7, "Full").when(s > 0.3, "Partial").otherwise("Control")
    return rows.withColumn("share", share).withColumn("dh_arm", arm)


def representativeness(original: DataFrame, kept: DataFrame, size: str = "n_addresses") -> DataFrame:
    """One row: what a bundle filter loses in bundles, segments and addresses, and how bundle sizes move."""
    def facts(members: DataFrame, tag: str) -> DataFrame:
        per = members.where("bundle_id is not null").groupBy("bundle_id").agg(F.count("*").alias("segments"), F.sum(size).alias("size"))
        return per.agg(F.count("*").alias(f"bundles_{tag}"), F.sum("segments").alias(f"segments_{tag}"), F.sum("size").alias(f"addresses_{tag}"), F.avg("size").alias(f"mean_{tag}"), F.stddev_samp("size").alias(f"std_{tag}"), F.min("size").alias(f"min_{tag}"), F.max("size").alias(f"max_{tag}"))

    both = facts(original, "before").crossJoin(F.broadcast(facts(kept, "after")))
    loss = lambda c: F.try_divide((F.col(f"{c}_before") - F.col(f"{c}_after")).cast("double"), F.col(f"{c}_before")).alias(f"{c}_lost")
    return both.select("*", loss("bundles"), loss("segments"), loss("addresses"))


def zero_targets(routes: DataFrame, counts: DataFrame) -> DataFrame:
    """(interviewer, task, n_segments, n_targets, n_zero): routed segments with the number of their targets, and how many have none."""
    steps = routes.select("interviewer", "task", "segment_id").distinct()
    joined = steps.join(counts.groupBy("segment_id").agg(F.sum("n").alias("n")), "segment_id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.groupBy("interviewer", "task").agg(F.count("*").alias("n_segments"), F.sum(n).alias("n_targets"), F.count_if(n == 0).alias("n_zero"))


def rows_of(frames: Iterator[DataFrame]) -> DataFrame:
    """All frames one below the other by column name; missing columns are null."""
    frames = iter(frames)
    out = next(frames)
    for frame in frames:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
