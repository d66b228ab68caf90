"""Queries of dates, texts, geometry and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import calendar, geo, text
from kerbline.operators import bundling, ranking
from kerbline.plans.registry import ACTIVITIES, ADDRESSES, BUNDLES, STREETS, WEEK, activities, addresses, bundles, query, rounded, streets, table


@query(f"SELECT event_id, {WEEK.format('ts')} - 7 AS first_day, {WEEK.format('ts')} - 1 AS last_day FROM events")
def dat02_preceding_range(spark, sf_dir):
    first, last = calendar.preceding_range(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", first.alias("first_day"), last.alias("last_day"))


@query(f"""
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start
    FROM (SELECT min({WEEK.format('o_orderdate')}) AS lo, max({WEEK.format('o_orderdate')}) AS hi FROM orders)
""")
def dat03_saturday_calendar(spark, sf_dir):
    span = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return calendar.saturdays(span, "a", "b")


@query("""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders
""")
def dat04_lenient_dates(spark, sf_dir):
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(kind == 0, "not a date").when(kind == 1, F.date_format(day, "M/d/y")).when(kind == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(calendar.lenient_timestamp(raw, "M/d/y")).alias("parsed"))


@query(f"""
    WITH {ACTIVITIES} SELECT report_id, CAST(floor((epoch_us(closed) - epoch_us(reported + INTERVAL 10 HOUR)) / 86400000000.0) AS BIGINT) AS whole,
      round((epoch_us(closed) - epoch_us(reported + INTERVAL 10 HOUR)) / 86400000000.0, 6) AS fraction FROM activities
""")
def dat05_day_differences(spark, sf_dir):
    rows = activities(spark, sf_dir).withColumn("at", F.col("reported") + F.expr("interval 10 hours"))
    return rows.select("report_id", calendar.whole_days(F.col("at"), F.col("closed")).alias("whole"), F.round(calendar.fractional_days(F.col("at"), F.col("closed")), 6).alias("fraction"))


@query("SELECT o_orderkey, weekofyear(o_orderdate)::INTEGER AS iso_week, year(o_orderdate)::INTEGER AS calendar_year, (isodow(o_orderdate) - 1)::INTEGER AS day_of_week FROM orders")
def dat06_week_fields(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.iso_week(day).alias("iso_week"), F.year(day).alias("calendar_year"), F.weekday(day).alias("day_of_week"))


@query(f"SELECT o_orderkey, {WEEK.format('o_orderdate')} + 7 AS next_saturday FROM orders")
def dat07_next_saturday(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.next_saturday(F.col("o_orderdate")).alias("next_saturday"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def dat08_any_date(spark, sf_dir):
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    serial = F.datediff(day, F.to_date(F.lit(calendar.SHEET_EPOCH))).cast("string")
    raw = F.when(kind == 0, serial).when(kind == 1, F.date_format(day, "yyyy-MM-dd")).when(kind == 2, F.date_format(day, " M/d/y ")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.any_date(raw).alias("parsed"))


@query("""
    WITH p AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '0000' WHEN 2 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS num,
        CASE WHEN c_custkey % 7 = 0 THEN '1/2' ELSE '' END AS frac, CASE WHEN c_custkey % 3 = 0 THEN 'N' END AS pdir,
        CASE c_custkey % 4 WHEN 0 THEN 'MAPLE' WHEN 1 THEN '32ND' WHEN 2 THEN 'o''farrell  hill' ELSE 'mcgraw-hill' END AS name,
        CASE c_custkey % 6 WHEN 0 THEN 'AV' WHEN 1 THEN 'st' WHEN 2 THEN 'AVENUE' WHEN 3 THEN 'row' WHEN 4 THEN '' ELSE 'PKWY' END AS sfx,
        CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN '9212' ELSE '92101-' || (1000 + c_custkey % 9) END AS zip FROM customer),
    q AS (SELECT k, CASE WHEN num IN ('0', '0000') OR num IS NULL THEN '' ELSE num END AS num, frac, coalesce(pdir, '') AS pdir,
        CASE k % 4 WHEN 0 THEN 'Maple' WHEN 1 THEN '32Nd' WHEN 2 THEN 'O''Farrell Hill' ELSE 'Mcgraw-Hill' END AS name,
        CASE k % 6 WHEN 0 THEN 'Ave' WHEN 1 THEN 'St' WHEN 2 THEN 'Ave' WHEN 3 THEN 'Row' WHEN 4 THEN '' ELSE 'Pkwy' END AS sfx, regexp_extract(coalesce(zip, ''), '\\d{5}') AS z FROM p),
    r AS (SELECT k, z, trim(regexp_replace(concat_ws(' ', num, frac, pdir, name, sfx), '\\s+', ' ', 'g')) AS line FROM q)
    SELECT k AS addr_id, CASE WHEN z = '' THEN line ELSE line || ', ' || z END AS address, k % 9 = 0 AS unit_blank FROM r
""")
def str01_addresses(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda n, *values: F.coalesce(*(F.when(k % n == i, v) for i, v in enumerate(values)))
    number = F.when(k % 5 == 0, "0").when(k % 5 == 1, "0000").when(k % 5 == 2, None).otherwise(k.cast("string"))
    zip_code = F.when(k % 8 == 0, None).when(k % 8 == 1, "9212").otherwise(F.concat(F.lit("92101-"), (1000 + k % 9).cast("string")))
    name, suffix = pick(4, "MAPLE", "32ND", "o'farrell  hill", "mcgraw-hill"), pick(6, "AV", "st", "AVENUE", "row", "", "PKWY")
    line = text.address(number, F.when(k % 7 == 0, "1/2").otherwise(""), F.when(k % 3 == 0, "N"), name, suffix, F.lit(None).cast("string"), zip_code)
    return table(spark, sf_dir, "customer").select(k.alias("addr_id"), line.alias("address"), text.unit_blank(F.when(k % 9 == 0, " ").otherwise("B")).alias("unit_blank"))


_KEY = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(upper(trim({0})), 'STREET', 'ST'), 'AVENUE', 'AVE'), 'BOULEVARD', 'BLVD'), 'ROAD', 'RD'), 'DRIVE', 'DR'), 'LANE', 'LN'), 'PLACE', 'PL'), 'COURT', 'CT'), 'CIRCLE', 'CIR'), '.', ''), ',', '')"


@query(f"WITH {ADDRESSES} SELECT addr_id, {_KEY.format('name')} AS street_key FROM addresses")
def str02_street_keys(spark, sf_dir):
    return addresses(spark, sf_dir).select("addr_id", text.street_key(F.col("name")).alias("street_key"))


@query(f"""
    WITH {ADDRESSES}, {STREETS}, s AS (SELECT segment_id, {_KEY.format('name')} AS b FROM streets), a AS (SELECT addr_id, {_KEY.format('name')} AS a FROM addresses)
    SELECT addr_id, segment_id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS matches FROM a JOIN s ON addr_id = segment_id
""")
def str03_name_match(spark, sf_dir):
    a = addresses(spark, sf_dir).select("addr_id", text.street_key(F.col("name")).alias("a"))
    b = streets(spark, sf_dir).select("segment_id", text.street_key(F.col("name")).alias("b"))
    return a.join(b, F.col("addr_id") == F.col("segment_id")).select("addr_id", "segment_id", text.names_match(F.col("a"), F.col("b")).alias("matches"))


@query("""
    SELECT c_custkey, (('0x' || substr(sha256('2026-03-14|A|' || c_custkey || '|DH|partial'), 1, 16))::UBIGINT % 4294967295)::BIGINT AS partial_seed,
      (('0x' || substr(sha256('2026-03-14|A|' || c_custkey || '|DH|treatment'), 1, 16))::UBIGINT % 4294967295)::BIGINT AS treatment_seed FROM customer
""")
def str04_stable_seeds(spark, sf_dir):
    day, who, k = F.lit("2026-03-14"), F.lit("A"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", text.partial_seed(day, who, k).alias("partial_seed"), text.treatment_seed(day, who, k).alias("treatment_seed"))


@query("""
    SELECT c_custkey, 'https://maps.example.org/?q=' || replace(url_encode(c_name || ' & Co'), '%20', '+') AS link, regexp_extract('https://docs.example.org/d/' || c_custkey || '_x-Y/edit', '/d/([A-Za-z0-9_-]+)', 1) AS sheet,
      lower(trim(regexp_replace('  ' || c_name || '  Jr ', '\\s+', ' ', 'g'))) AS person FROM customer
""")
def str05_links(spark, sf_dir):
    name, k = F.col("c_name"), F.col("c_custkey").cast("string")
    link = F.concat(F.lit("https://docs.example.org/d/"), k, F.lit("_x-Y/edit"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.map_link(F.concat(name, F.lit(" & Co"))).alias("link"), text.sheet_id(link).alias("sheet"), text.person_key(F.concat(F.lit("  "), name, F.lit("  Jr "))).alias("person"))


@query("""
    SELECT event_id, concat_ws(', ', CASE WHEN k = 0 THEN 'Clear' WHEN k <= 3 THEN 'Partly cloudy' WHEN k <= 48 THEN 'Fog' WHEN k <= 67 THEN 'Rain' WHEN k <= 77 THEN 'Snow' WHEN k <= 82 THEN 'Showers' ELSE 'Thunderstorm' END,
      'high ' || (k // 2)::VARCHAR, 'rain ' || k || '%') AS summary FROM (SELECT event_id, (props ->> '$.k')::INTEGER AS k FROM events)
""")
def str06_weather(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    payload = F.to_json(F.struct(k.alias("code"), F.floor(k / 2).cast("double").alias("high"), k.alias("rain")))
    return table(spark, sf_dir, "events").select("event_id", text.weather_summary(payload).alias("summary"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS plan_date FROM orders")
def str07_plan_file_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    path = F.when(F.col("o_orderkey") % 5 == 0, F.lit("plans/bundles_plan_draft.csv")).otherwise(F.concat(F.lit("plans/2020-01-01/bundles_plan_"), day, F.lit(".csv")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_in_name(path).alias("plan_date"))


@query("""
    WITH p AS (SELECT s_suppkey, 32.5 + (s_suppkey % 40) / 50.0 AS lat1, -117.3 + (s_suppkey % 30) / 50.0 AS lon1, 32.7 + (s_suppkey % 7) / 30.0 AS lat2, -117.1 + (s_suppkey % 11) / 40.0 AS lon2 FROM supplier),
    h AS (SELECT s_suppkey, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2) AS a FROM p)
    SELECT s_suppkey, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM h
""")
def geo01_haversine(spark, sf_dir):
    k = F.col("s_suppkey")
    km = geo.haversine_km(32.5 + (k % 40) / 50.0, -117.3 + (k % 30) / 50.0, 32.7 + (k % 7) / 30.0, -117.1 + (k % 11) / 40.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(km, 6).alias("km"))


_LEN = "sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l1, sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) AS l2"


@query(f"WITH {STREETS} SELECT segment_id, round(l1 + l2, 6) AS length, round(3 / nullif(l1 + l2, 0) * 100, 6) AS density FROM (SELECT segment_id, {_LEN} FROM streets)")
def prj03_segment_length(spark, sf_dir):
    rows = streets(spark, sf_dir).select("segment_id", geo.length(F.col("line")).alias("l"))
    return rows.select("segment_id", F.round("l", 6).alias("length"), F.round(F.expr("try_divide(3, nullif(l, 0)) * 100"), 6).alias("density"))


@query(f"""
    WITH {STREETS}, m AS (SELECT segment_id // 10 AS bundle_id, l1 + l2 AS l, l1 * (x1 + x2) / 2 + l2 * (x2 + x3) / 2 AS mx, l1 * (y1 + y2) / 2 + l2 * (y2 + y3) / 2 AS my FROM (SELECT *, {_LEN} FROM streets))
    SELECT bundle_id, round(sum(mx) / sum(l), 4) AS x, round(sum(my) / sum(l), 4) AS y, round(sum(l) / 1000, 6) AS km FROM m GROUP BY 1
""")
def geo02_centroids(spark, sf_dir):
    rows = streets(spark, sf_dir)
    members = rows.select("segment_id", F.floor(F.col("segment_id") / 10).alias("bundle_id"))
    return bundling.centroids(members, rows).select("bundle_id", *rounded("x", "y"), F.round("km", 6).alias("km"))


@query(f"WITH {STREETS} SELECT segment_id, x1 AS first_x, y1 AS first_y, x3 AS last_x, y3 AS last_y FROM streets")
def geo03_endpoints(spark, sf_dir):
    a, b = geo.first_point(F.col("line")), geo.last_point(F.col("line"))
    return streets(spark, sf_dir).select("segment_id", a["x"].alias("first_x"), a["y"].alias("first_y"), b["x"].alias("last_x"), b["y"].alias("last_y"))


@query("SELECT o_orderkey, round_even(o_totalprice / 0.5, 0)::BIGINT AS snapped, round_even((o_orderkey % 100) / 2.0 / 0.5 + 0.5, 0)::BIGINT AS half FROM orders")
def geo04_grid_snap(spark, sf_dir):
    k = (F.col("o_orderkey") % 100) / 2.0 + 0.25
    return table(spark, sf_dir, "orders").select("o_orderkey", geo.snap(F.col("o_totalprice")).alias("snapped"), geo.snap(k).alias("half"))


@query(f"WITH {STREETS} SELECT min(least(x1, x2, x3)) AS x0, min(least(y1, y2, y3)) AS y0, max(greatest(x1, x2, x3)) AS x1, max(greatest(y1, y2, y3)) AS y1, count(*) AS n FROM streets")
def geo05_total_bounds(spark, sf_dir):
    b = streets(spark, sf_dir).select(geo.bounds(F.col("line")).alias("b"))
    return b.agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"), F.count("*").alias("n"))


@query(f"""
    WITH {STREETS} SELECT DISTINCT segment_id // 10 AS bundle_id, unnest([round_even(x1 / 0.5, 0)::BIGINT || ':' || round_even(y1 / 0.5, 0)::BIGINT, round_even(x3 / 0.5, 0)::BIGINT || ':' || round_even(y3 / 0.5, 0)::BIGINT]) AS node FROM streets
""")
def geo06_endpoint_index(spark, sf_dir):
    rows = streets(spark, sf_dir)
    facts = bundling.segment_facts(rows.withColumn("n", F.lit(1)))
    return bundling.endpoint_index(rows.select("segment_id", F.floor(F.col("segment_id") / 10).alias("bundle_id")), facts)


@query(f"WITH {STREETS} SELECT segment_id, x1 AS x, y1 AS y FROM streets")
def geo07_start_points(spark, sf_dir):
    p = geo.first_point(F.col("line"))
    return streets(spark, sf_dir).select("segment_id", p["x"].alias("x"), p["y"].alias("y"))


@query("SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, l_discount * 12)) AS clipped, abs(l_quantity - 25) AS off, sign(l_quantity - 25)::INTEGER AS side, ceil(l_quantity / 7)::BIGINT AS up, trunc(l_quantity / 7)::INTEGER AS cut, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem")
def mth01_arithmetic(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l_discount") * 12)).alias("clipped"), F.abs(q - 25).alias("off"), F.signum(q - 25).cast("int").alias("side"),
        F.ceil(q / 7).alias("up"), (q / 7).cast("int").alias("cut"), F.round(F.expr("try_divide(l_tax, nullif(l_discount, 0))"), 6).alias("ratio"),
    )


@query(f"""
    WITH {BUNDLES}, s AS (SELECT bundle_id, list_sort(list(DISTINCT segment_id)) AS segs FROM bundles GROUP BY 1)
    SELECT bundle_id, len(segs) AS n, list_contains(segs, bundle_id * 20 + 3) AS has_third, list_has_any(segs, [40, 41, 1000]) AS touches, len(list_concat(segs, [1, 2])) AS longer, len(list_filter(segs, lambda x: x % 2 = 0)) AS even FROM s
""")
def arr01_list_columns(spark, sf_dir):
    segs = F.sort_array(F.collect_set("segment_id"))
    rows = bundles(spark, sf_dir).groupBy("bundle_id").agg(segs.alias("segs"))
    size = lambda c: F.size(c).cast("bigint")
    return rows.select(
        "bundle_id", size(F.col("segs")).alias("n"), F.array_contains("segs", F.col("bundle_id") * 20 + 3).alias("has_third"), F.arrays_overlap("segs", F.array(F.lit(40), F.lit(41), F.lit(1000)).cast("array<bigint>")).alias("touches"),
        size(F.concat("segs", F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))).alias("longer"), size(F.filter("segs", lambda x: x % 2 == 0)).alias("even"),
    )


@query(f"WITH {BUNDLES} SELECT bundle_id, max(n_addresses) FILTER (segment_id % 20 = 5) AS fifth, count(*) AS entries FROM bundles GROUP BY 1")
def arr02_map_columns(spark, sf_dir):
    pairs = F.map_from_entries(F.collect_list(F.struct((F.col("segment_id") % 20).alias("k"), F.col("n_addresses").alias("v"))))
    rows = bundles(spark, sf_dir).groupBy("bundle_id").agg(pairs.alias("m"))
    return rows.select("bundle_id", F.try_element_at("m", F.lit(5).cast("bigint")).alias("fifth"), F.size("m").cast("bigint").alias("entries"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, '{\"k\":' || (props ->> '$.k') || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def arr03_json(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("doc"))


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS seq FROM customer")
def win05_group_sequence(spark, sf_dir):
    return ranking.sequence(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_custkey").select("c_mktsegment", "c_custkey", F.col("seq").cast("bigint").alias("seq"))
