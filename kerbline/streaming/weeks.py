"""Weekly eligibility over a stream of reports: Saturday weeks as tumbling windows, used bundles as state.

A report that arrives after its week was closed by the watermark is dropped, where a batch run would count it; ``late`` is how long weeks stay open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def weekly_reports(reports: DataFrame, ts: str, unit: str, late: str = "7 days") -> DataFrame:
    """(week_start, unit, n) of a stream; windows of seven days that begin on Saturdays in UTC, closed by the watermark."""
    # The epoch was a Thursday: two days on is a Saturday.
    stamped = reports.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    window = F.window("_ts", "7 days", "7 days", "2 days")
    counted = stamped.groupBy(window.alias("w"), F.col(unit).alias("unit")).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("w.start").alias("week_start"), "unit", "n")


def eligible_bundles(reports: DataFrame, members: DataFrame, ts: str, late: str = "7 days") -> DataFrame:
    """(week_start, bundle_id, n): bundles that become eligible for the week after each closed one; a stream joined with the static membership table."""
    named = reports.join(members.select("segment_id", "bundle_id"), "segment_id")
    weeks = weekly_reports(named, ts, "bundle_id", late)
    return weeks.select(F.date_add("week_start", 7).alias("week_start"), F.col("unit").alias("bundle_id"), "n")


def first_uses(plans: DataFrame) -> DataFrame:
    """(bundle_id, date): a streamed plan's rows whose bundle was never planned before; the state of a bundle is its first date."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dates = [d for part in parts for d in part["date"] if d is not None]
        if dates and not state.exists:
            first = min(dates)
            state.update((str(first),))
            yield pd.DataFrame({"bundle_id": [key[0]], "date": [first]})

    return plans.where("bundle_id is not null").select("bundle_id", "date").groupBy("bundle_id").applyInPandasWithState(
        run, "bundle_id bigint, date date", "first string", "append", GroupStateTimeout.NoTimeout
    )


def append_weeks(weeks: DataFrame, target: str, checkpoint: str):
    """Write closed weeks to ``target`` partitioned by week, exactly once, and return the running query."""
    return weeks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("week_start").outputMode("append").trigger(availableNow=True).start()
