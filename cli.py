"""Command line of the planning jobs: spark-submit cli.py COMMAND ... over Parquet tables."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from kerbline.plans import jobs
from kerbline.sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name, *paths: [c := commands.add_parser(name)] + [c.add_argument(f"--{p}", required=True) for p in paths]
    for name, paths in {
        "sweep": ("addresses", "streets", "out"), "bundle": ("segments", "out"), "plan": ("activities", "members", "past", "places", "workers", "out"),
        "emit": ("plan", "arms", "table", "segments", "addresses", "assigned", "activities", "out"), "doctor": ("streets", "addresses", "activities"),
        "export-crosswalk": ("mapping", "out"), "simulate": ("activities", "members", "out"),
    }.items():
        command = add(name, *paths)[0]
        if name in ("plan", "emit"):
            command.add_argument("--date", type=dt.date.fromisoformat, required=True)
        if name == "sweep":
            command.add_argument("--buffers", type=float, nargs="+", default=[40.0])
            command.add_argument("--minima", type=int, nargs="+", default=[2])
        if name == "bundle":
            command.add_argument("--target", type=int, default=120)
            command.add_argument("--method", choices=["greedy", "balanced"], default="balanced")
            command.add_argument("--seed", type=int, default=42)
            command.add_argument("--multiplier", type=float, default=1.2)
        if name == "simulate":
            command.add_argument("--first", type=dt.date.fromisoformat, required=True)
            command.add_argument("--weeks", type=int, default=30)
            command.add_argument("--covariates", nargs="+", default=[])
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kerbline").getOrCreate()
    read = lambda name: spark.read.parquet(getattr(args, name))
    if args.command == "sweep":
        sinks.write_scenarios(*jobs.sweep(read("addresses"), read("streets"), args.buffers, args.minima), args.out)
    elif args.command == "bundle":
        sinks.write_bundles(jobs.bundle(read("segments"), args.target, args.method, args.seed, args.multiplier), args.out)
    elif args.command == "plan":
        past = tables.read_optional(spark, lambda: tables.read_plans(spark, args.past))
        past = spark.createDataFrame([], tables.PLAN) if past is None else past
        found = jobs.plan(args.date, jobs.reported_weeks(read("activities")), read("members"), past, read("places"), read("workers"))
        sinks.write_plan(found.rows, f"{args.out}/bundles_plan_{args.date}")
        sinks.write_table(found.arms, f"{args.out}/segment_assignments_{args.date}")
        sinks.write_report(found.metadata, f"{args.out}/bundle_metadata_{args.date}", "task", "bundle_id")
    elif args.command == "emit":
        tables_ = (read(n) for n in ("plan", "arms", "table", "segments", "addresses", "assigned"))
        jobs.emit(args.date, *tables_, jobs.reported_weeks(read("activities")), args.out)
    elif args.command == "doctor":
        row = jobs.doctor({"streets": read("streets"), "addresses": read("addresses")}, read("activities"), "segment_id", "reported").first()
        print(json.dumps(row.asDict(), default=str))
    elif args.command == "export-crosswalk":
        jobs.export_crosswalk(read("mapping"), args.out)
    else:
        weeks = [args.first + dt.timedelta(days=7 * i) for i in range(args.weeks)]
        sinks.write_simulation(jobs.simulate(weeks, jobs.reported_weeks(read("activities")), read("members"), args.covariates), args.out)


if __name__ == "__main__":
    main()
