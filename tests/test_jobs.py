"""The chained jobs on the smallest tables, and the streamed weeks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import cli
from kerbline.operators import bundling
from kerbline.plans import jobs, networks
from kerbline.plans.registry import activities, addresses, streets
from kerbline.plans.spatial_joins import workers
from kerbline.streaming import weeks as stream

DIR = "/root/testdata/sf0.01"
DAY = dt.date(2026, 3, 14)


@pytest.fixture(scope="module")
def world(spark):
    """A grid of bundled streets with addresses, reports of the week before the plan, and a crew of six."""
    segments = networks.grid(spark, DIR, 14).drop("bundle_id").cache()
    table = bundling.component_table(segments).cache()
    bundled = bundling.bundle_segments(table, 90).where("bundle_id is not null").cache()
    places = bundling.centroids(bundled, segments).select("bundle_id", (32.5 + F.col("y") / 111000).alias("lat"), (-117.0 + F.col("x") / 93000).alias("lon"), "km")
    reports = segments.where("segment_id % 9 = 0").select("segment_id", F.lit(dt.datetime(2026, 3, 9, 12)).alias("reported"), F.lit(dt.datetime(2026, 3, 11)).alias("closed"))
    p = F.col("line")[0]
    points = segments.select("segment_id", "line", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).select((F.col("segment_id") * 10 + F.col("i")).alias("addr_id"), "segment_id", F.concat(F.col("i").cast("string"), F.lit(" Elm St")).alias("address"), (500000 + p["x"] + F.col("i")).alias("x"), (3600000 + p["y"]).alias("y"))
    crew = workers(spark, DIR).orderBy("name").limit(6)
    return dict(segments=segments, table=table, members=bundled.select("segment_id", "bundle_id", "n").cache(), places=places.cache(), activities=jobs.reported_weeks(reports).cache(), points=points.cache(), workers=crew.cache())


def empty_past(spark):
    return spark.createDataFrame([], "date date, interviewer string, task string, bundle_id bigint, bundle_type string, list_code int, sfh_bundle_total bigint")


def test_plan_and_pack_of_two_weeks(spark, world, tmp_path):
    first = jobs.plan(DAY, world["activities"], world["members"], empty_past(spark), world["places"], world["workers"])
    rows = first.rows.collect()
    assert len(rows) == 24 and len({r["bundle_id"] for r in rows}) == 24 and {r["task"] for r in rows} == {"DH"}
    assert sum(r["bundle_type"] == "conditional" for r in rows) == 4
    assert sorted(n for n in __import__("collections").Counter(r["interviewer"] for r in rows).values()) == [4] * 6
    second = jobs.plan(DAY + dt.timedelta(days=7), world["activities"], world["members"], first.rows, world["places"], world["workers"])
    later = second.rows.collect()
    dh, d2ds = ([r["bundle_id"] for r in later if r["task"] == t] for t in ("DH", "D2DS"))
    assert len(dh) == len(d2ds) == 6 and not set(dh) & {r["bundle_id"] for r in rows}
    assert all(r["interviewer"] for r in later)
    arms = {r["dh_arm"] for r in first.arms.collect()}
    assert arms <= {"Full", "Partial", "Control"} and first.metadata.count() == 24
    table = world["table"].join(world["members"].select("segment_id", "bundle_id"), "segment_id")
    assigned, points = world["points"].select("addr_id", "segment_id"), world["points"].drop("segment_id")
    pack = jobs.emit(DAY, first.rows, first.arms, table, world["segments"], points, assigned, world["activities"], str(tmp_path / "pack"))
    routes = pack["routes"].collect()
    planned = world["members"].join(first.rows.select("bundle_id"), "bundle_id").count()
    assert len({r["segment_id"] for r in routes}) == planned and sum(r["start_flag"] for r in routes) == 24
    kept = pack["points"].groupBy("dh_treatment").count().collect()
    assert {r["dh_treatment"] for r in kept} <= {"full", "partial"}
    assert pack["starts"].where("address is null").count() == 0
    assert {p.name for p in (tmp_path / "pack").iterdir()} == {"routes", "segments", "sfh_points", "starts", "segment_analysis"}
    with pytest.raises(ValueError):
        jobs.plan(dt.date(2026, 1, 5), world["activities"], world["members"], empty_past(spark), world["places"], world["workers"])


def test_simulation(spark, world):
    days = [DAY + dt.timedelta(days=7 * i) for i in range(3)]
    members = world["members"].withColumn("v", (F.col("segment_id") % 13).cast("double"))
    out = jobs.simulate(days, world["activities"], members, ["v"])
    stats = sorted(out["stats"].collect(), key=lambda r: r["week"])
    assert [r["dh_bundles"] for r in stats] == [24, 6, 6] or stats[0]["dh_bundles"] == 24
    assert [r["d2ds_bundles"] for r in stats] == [0, 6, 6]
    plan = out["plan"].where("task = 'DH'")
    assert plan.count() == plan.select("bundle_id").distinct().count()
    assert stats[-1]["cumulative_total"] == sum(r["total_addresses"] for r in stats)
    assert out["balance"].count() == 3 and all(r["p_value"] is None or 0 <= r["p_value"] <= 1 for r in out["balance"].collect())
    used = [r for r in out["overlap"].collect() if r["category"] == "Total (used)"]
    assert used[0]["bundles"] == out["plan"].select("bundle_id").distinct().count()


def test_command_line(spark, world, tmp_path, capsys):
    world["segments"].write.parquet(str(tmp_path / "segments.parquet"))
    cli.main(["bundle", "--segments", str(tmp_path / "segments.parquet"), "--out", str(tmp_path / "bundles"), "--target", "90", "--method", "greedy"], spark)
    assert spark.read.parquet(str(tmp_path / "bundles")).where("bundle_id is null").count() == 0
    streets(spark, DIR).write.parquet(str(tmp_path / "streets"))
    addresses(spark, DIR).write.parquet(str(tmp_path / "addresses"))
    cli.main(["sweep", "--addresses", str(tmp_path / "addresses"), "--streets", str(tmp_path / "streets"), "--out", str(tmp_path / "sweep"), "--buffers", "40", "80", "--minima", "1"], spark)
    assert {r["scenario"] for r in spark.read.parquet(str(tmp_path / "sweep/eligible")).select("scenario").distinct().collect()} == {"b40_m1", "b80_m1"}
    activities(spark, DIR).write.parquet(str(tmp_path / "acts"))
    cli.main(["doctor", "--streets", str(tmp_path / "streets"), "--addresses", str(tmp_path / "addresses"), "--activities", str(tmp_path / "acts")], spark)
    assert '"events": 15000' in capsys.readouterr().out
    cli.main(["export-crosswalk", "--mapping", str(tmp_path / "sweep/segment_addresses"), "--out", str(tmp_path / "cross")], spark)
    assert spark.read.csv(str(tmp_path / "cross"), header=True).columns == ["addr_id", "segment_id"]


def test_streamed_weeks_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    weeks = stream.weekly_reports(source, "ts", "user_id", "60 days")
    query = weeks.writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    from kerbline.operators.panel import weekly_counts

    want = {tuple(r) for r in weekly_counts(events, "user_id", "ts").select("week_start", "unit", "n_events").collect()}
    assert {tuple(r) for r in spark.table("weeks").collect()} == want


def test_streamed_first_uses(spark, tmp_path):
    rows = [(5, dt.date(2026, 3, 7)), (5, dt.date(2026, 3, 14)), (6, dt.date(2026, 3, 14)), (None, DAY)]
    spark.createDataFrame(rows, "bundle_id bigint, date date").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("bundle_id bigint, date date").parquet(str(tmp_path / "in"))
    query = stream.first_uses(source).writeStream.format("memory").queryName("uses").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("uses").collect()} == {(5, dt.date(2026, 3, 7)), (6, dt.date(2026, 3, 14))}
