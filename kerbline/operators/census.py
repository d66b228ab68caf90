"""Census units and sample demographics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shares(units: DataFrame, population: str, groups: dict[str, str], income: str, degrees: list[str], adults: str) -> DataFrame:
    """``units`` with a share of the population for each of ``groups`` (null where nobody lives), the college share of adults, and negative incomes as null."""
    of = lambda n, d: F.expr(f"try_divide(cast({n} as double), nullif({d}, 0))")
    out = units.withColumns({name: of(column, population) for name, column in groups.items()})
    out = out.withColumn("share_college", of(f"({' + '.join(degrees)})", adults))
    return out.withColumn(income, F.when(F.col(income) >= 0, F.col(income)))


def attach(segments: DataFrame, block_groups: DataFrame, tracts: DataFrame) -> DataFrame:
    """Segments (segment_id, GISJOIN_BG, GISJOIN_TRACT) with the columns of both census levels; units that aren't found give nulls."""
    named = lambda d, key: d.withColumnRenamed("GISJOIN", key)
    return segments.join(named(block_groups, "GISJOIN_BG"), "GISJOIN_BG", "left").join(named(tracts, "GISJOIN_TRACT"), "GISJOIN_TRACT", "left")


def sample_means(segments: DataFrame, samples: dict[str, DataFrame | None], columns: list[str]) -> DataFrame:
    """(sample, n_segments, means): means of ``columns`` over each sample of segment_id; None stands for all segments. Nulls don't count."""
    parts = None
    for name, keys in samples.items():
        rows = segments if keys is None else segments.join(keys.select("segment_id").distinct(), "segment_id", "left_semi")
        one = rows.agg(F.count("*").alias("n_segments"), *(F.avg(c).alias(c) for c in columns)).select(F.lit(name).alias("sample"), "n_segments", *columns)
        parts = one if parts is None else parts.unionByName(one)
    return parts


def formatted(means: DataFrame, money: list[str], percent: list[str]) -> DataFrame:
    """The table of means as text: whole dollars and percentages with one digit."""
    out = means.withColumns({c: F.concat(F.lit("$"), F.format_number(F.col(c), 0)) for c in money})
    return out.withColumns({c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%")) for c in percent})
