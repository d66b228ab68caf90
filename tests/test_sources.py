"""Readers and writers over files in a temporary folder."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kerbline.sources import sinks, tables

DAY = dt.date(2026, 3, 14)


def test_plans_of_all_layouts(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("bundles_plan_2026-01-10.csv", "date,interviewer,task,bundle_id,list_code\n2026-01-10,A,DH,7,1\n2026-01-10,B,DH\n")
    write("bundles_plan_2026-03-07.csv", "date,interviewer,task,bundle_id,bundle_type,list_code,sfh_bundle_total\n2026-03-07,A,D2DS,8.0,d2ds_random,2,90\n")
    write("bundles_plan_draft.csv", "date,interviewer,task,bundle_id,list_code\n2026-03-07,A,DH,9,1\n")
    write("other_2026-01-10.csv", "date\n1\n")
    got = sorted(tuple(r) for r in tables.read_plans(spark, str(tmp_path)).collect())
    assert got == [(dt.date(2026, 1, 10), "A", "DH", 7, None, 1, None), (dt.date(2026, 3, 7), "A", "D2DS", 8, "d2ds_random", 2, 90)]
    assert [r["bundle_id"] for r in tables.read_plans(spark, str(tmp_path), F.lit(dt.date(2026, 2, 1)), F.lit(DAY)).collect()] == [8]


def test_written_plans_are_read_back(spark, tmp_path):
    rows = [(DAY, "B", "DH", 2, "random", 1, 50), (DAY, "A", "DH", 1, "conditional", 1, 60)]
    sinks.write_plan(spark.createDataFrame(rows, tables.PLAN), str(tmp_path / f"bundles_plan_{DAY}"))
    part = next((tmp_path / f"bundles_plan_{DAY}").glob("part-*.csv"))
    part.rename(tmp_path / f"bundles_plan_{DAY}.csv")
    assert [tuple(r) for r in tables.read_plans(spark, str(tmp_path)).orderBy("interviewer").collect()] == rows[::-1]


def test_dense_numbers(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k")).repartition(7)
    got = tables.ensure_column(df, "row_id", ["OBJECTID"], "k").collect()
    assert all(r["row_id"] == r["k"] + 1 for r in got) and len(got) == 100
    assert tables.ensure_column(df.withColumnRenamed("k", "OBJECTID"), "row_id", ["objectid"]).columns == ["row_id"]
    assert tables.number_rows(df.where("false"), "n", "k").count() == 0


def test_key_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code\n x \nx\n\ny\n")
    assert sorted(r[0] for r in tables.read_keys(spark, str(tmp_path / "a.csv"), "zone").collect()) == ["x", "y"]
    (tmp_path / "b.csv").write_text("p,q\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_keys(spark, str(tmp_path / "b.csv"), "zone")


def test_optional_and_mandatory_layers(spark, tmp_path):
    missing = str(tmp_path / "none.parquet")
    assert tables.read_optional(spark, lambda: spark.read.parquet(missing)) is None
    with pytest.raises(FileNotFoundError):
        tables.read_segment_demographics(spark, missing)


def test_cache(spark, tmp_path):
    cache, calls = str(tmp_path / "cache"), []

    def fetch():
        calls.append(1)
        if len(calls) == 2:
            raise OSError("offline")
        return spark.range(len(calls))

    with pytest.raises(FileNotFoundError):
        tables.read_cached(spark, cache)
    assert tables.read_cached(spark, cache, fetch).count() == 1
    assert tables.read_cached(spark, cache, fetch).count() == 1 and len(calls) == 1
    assert tables.read_cached(spark, cache, fetch, refresh=True).count() == 1 and len(calls) == 2
    assert tables.read_cached(spark, cache, fetch, refresh=True).count() == 3


def test_latest_file(spark, tmp_path):
    import os

    for i, name in enumerate(("eligible_a.parquet", "eligible_b.parquet", "eligible_c.txt")):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (1_700_000_000 + (5 - i) * 60,) * 2)
    assert tables.latest_file(spark, str(tmp_path)).endswith("eligible_a.parquet")
    assert tables.latest_file(spark, str(tmp_path / "none")) is None


def test_geojson(spark, tmp_path):
    shapes = [("Point", [1.5, 2.5]), ("LineString", [[0, 0], [3, 4]]), ("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]])]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": k}, "geometry": {"type": k, "coordinates": c}} for k, c in shapes]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    rows = {r["name"]: r for r in tables.read_layer(spark, {"path": str(tmp_path / "a.geojson"), "properties": "name string", "crs_input": "EPSG:4326"}).collect()}
    assert (rows["Point"]["x"], rows["Point"]["y"], rows["Point"]["crs"]) == (1.5, 2.5, "EPSG:4326")
    assert [tuple(p) for p in rows["LineString"]["line"]] == [(0, 0), (3, 4)] and len(rows["Polygon"]["ring"]) == 4
    lines = tables.read_geojson(spark, str(tmp_path / "a.geojson"), "name string").where("line is not null")
    sinks.write_geojson(lines, ["name"], str(tmp_path / "out"))
    back = json.loads(next((tmp_path / "out").glob("part-*.txt")).read_text())
    assert back == {"type": "Feature", "properties": {"name": "LineString"}, "geometry": {"type": "LineString", "coordinates": [[0.0, 0.0], [3.0, 4.0]]}}


def test_roster_and_locations(spark):
    days = spark.createDataFrame([("3/14/2026", "Ann", " bob ", None), ("2026-03-21", "Cy", "", "")], "Date string, A string, B string, C string")
    people = spark.createDataFrame([("ann", None, "1 Elm", None, None), ("Bob", None, "2 Oak", 1.0, 2.0), ("Cy", None, "3 Ash", None, None)], tables.WORKERS)
    cache = spark.createDataFrame([(" 1 ELM", 3.0, 4.0)], "address string, lat double, lon double")
    located = tables.locate(people, cache)
    got = sorted(tuple(r) for r in tables.roster(days, located, F.lit(DAY)).collect())
    assert got == [("A", "Ann", 3.0, 4.0), ("B", "bob", 1.0, 2.0)]
    geocode = lambda a: F.struct(F.lit(9.0).alias("lat"), F.length(a).cast("double").alias("lon"))
    assert tables.locate(people, cache, geocode).where("name = 'Cy'").first()["lat"] == 9.0
    starting = spark.createDataFrame([("A", "DH", 5, "1 Elm St"), ("A", "DH", 4, "9 Elm St"), ("B", "DH", 1, "")], "interviewer string, task string, segment_id bigint, address string")
    mails = spark.createDataFrame([("ANN", "a@example.org"), ("bob", "b@example.org")], "name string, email string")
    out = sinks.messages(tables.roster(days, located, F.lit(DAY)), mails, starting).collect()
    assert [(r["email"], r["segment_id"], r["link"].endswith("9+Elm+St")) for r in out] == [("a@example.org", 4, True)]


def test_small_sheets_and_census(spark, tmp_path):
    assert [tuple(r) for r in tables.pad_rows(spark, [["a", "b"], [1], [2, 3, 4]]).collect()] == [("1", None), ("2", "3")]
    assert tables.pad_rows(spark, []).count() == 0
    (tmp_path / "c.csv").write_text("GISJOIN,U1\nGIS Join code,Total\nG06007,5\n")
    assert [tuple(r) for r in tables.read_census(spark, str(tmp_path / "c.csv")).collect()] == [("G06007", "5")]


def test_settings_and_binding(spark, tmp_path):
    spark.createDataFrame([("s1",), ("s2",)], "IAMFLOC string").write.parquet(str(tmp_path / "streets.parquet"))
    spark.createDataFrame([(1.0, 2.0)], "x double, y double").write.parquet(str(tmp_path / "addrs.parquet"))
    (tmp_path / "s.yaml").write_text(json.dumps({"segments": {"path": str(tmp_path / "streets.parquet")}, "addresses": {"path": str(tmp_path / "addrs.parquet")}}))
    (tmp_path / "p.yaml").write_text(json.dumps({"zoning": {"mode": "exclude", "codes": ["RS"]}}))
    settings = tables.load_settings(tmp_path / "s.yaml", tmp_path / "p.yaml")
    bound = tables.bind_sources(spark, settings)
    assert bound["streets"].columns == ["segment_id"] and bound["addresses"].first()["addr_id"] == 1
    layers = tables.load_filter_layers(spark, settings)
    assert (layers.zoning, layers.mode, layers.codes) == (None, "exclude", ("RS",))
    with pytest.raises(KeyError):
        tables.bind_sources(spark, tables.Settings())


def test_bundle_table(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None)], "segment_id int, bundle_id double").write.parquet(str(tmp_path / "b.parquet"))
    assert sorted(tuple(r) for r in tables.read_bundles(spark, str(tmp_path / "b.parquet")).collect()) == [("1", 5), ("2", None), ("3", None)]
    kept = tables.assigned_addresses(spark.createDataFrame([(1, 7), (2, 8)], "segment_id int, addr_id int"), spark.createDataFrame([(7, "x")], "addr_id int, a string"), spark.createDataFrame([(1,)], "segment_id int"))
    assert kept.count() == 1
    cross = sinks.crosswalk(spark.createDataFrame([(7, 3), (7, 2), (None, 1)], "addr_id int, segment_id int"))
    assert [tuple(r) for r in cross.collect()] == [(7, 2)]


def test_copies_and_archives(spark, tmp_path):
    import zipfile

    from kerbline.sources import transfer

    source = tmp_path / "pack"
    source.mkdir()
    (source / "routes.csv").write_text("a\n1\n")
    (source / "starts.csv").write_text("b\n2\n")
    (source / "sub").mkdir()
    assert transfer.children(spark, str(source)) == ["routes.csv", "starts.csv"] and transfer.children(spark, str(tmp_path / "none")) == []
    assert transfer.publish(spark, str(source), str(tmp_path / "drive"), "2026-03-14") == ["routes.csv", "starts.csv"]
    (source / "routes.csv").write_text("a\n9\n")
    transfer.publish(spark, str(source), str(tmp_path / "drive"), "2026-03-14", "routes*")
    assert (tmp_path / "drive/2026-03-14/routes.csv").read_text() == "a\n9\n" and (tmp_path / "drive/2026-03-14/starts.csv").exists()
    (tmp_path / "drive/2026-03-15").write_text("a file in the way")
    with pytest.raises(Exception):
        transfer.publish(spark, str(source), str(tmp_path / "drive"), "2026-03-15")
    with zipfile.ZipFile(source / "a.zip", "w") as z:
        z.writestr("x/one.csv", "k\n1\n")
        z.writestr("two.bin", b"\x00")
    (source / "b.zip").write_bytes(b"broken")
    got = transfer.archive_members(spark, str(source), (".csv",)).collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("x/one.csv", b"k\n1\n")]
    assert [r["line"] for r in transfer.extract(spark, str(source), str(tmp_path / "lines"), (".csv",)).orderBy("at").collect()] == ["k", "1", ""]


def test_map_page(spark, tmp_path):
    lines = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.0}], "a<b"), ([{"x": 1.0, "y": 1.0}], "dot"), (None, "none")], "line array<struct<x:double,y:double>>, label string")
    sinks.write_map({"streets": lines, "empty": lines.where("false")}, "Day", str(tmp_path / "map"))
    page = next((tmp_path / "map").glob("part-*")).read_text()
    assert page.count("<path") == 1 and "a&lt;b" in page and 'viewBox="0.0 -4.0 3.0 4.0"' in page
    assert sinks.order_columns(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), ["c", "z", "a"]).columns == ["c", "a", "b"]
