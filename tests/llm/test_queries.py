"""Registered queries against their SQL, and rows that every query must take: nulls, repeats, empty tables, other columns."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kerbline.llm import queries

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{DIR}/{table}.parquet')")
    cur = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The small tables with nulls in every column, repeated rows, empty texts and columns of clashing names."""
    root = tmp_path_factory.mktemp("odd")
    for table in TABLES:
        rows = spark.read.parquet(f"{DIR}/{table}.parquet").limit(60)
        key = rows.columns[0]
        blank = rows.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
        bare = rows.limit(3).select(*((F.lit("") if f.dataType.simpleString() == "string" else F.col(f.name)).alias(f.name) for f in rows.schema))
        rows = rows.union(rows.orderBy(key).limit(5)).union(blank).union(bare)
        for name in ("score", "n", "odd", "part", "key", "fold", "held_out", "rank", "_m"):
            rows = rows.withColumn(name, F.lit("x"))
        rows.write.parquet(f"{root}/{table}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for table in TABLES:
        spark.read.parquet(f"{DIR}/{table}.parquet").where("false").write.parquet(f"{root}/{table}.parquet")
    return str(root)


PER_ROW = {"op1_token_store", "op2_language_id", "op5_toxicity", "op7_near_duplicates", "op8_byte_bpe", "op9_token_counts", "op10_katz"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, odd, empty, name):
    want = queries.QUERIES[name](spark, DIR)
    got = queries.QUERIES[name](spark, odd)
    assert got.schema.names == want.schema.names
    rows = got.collect()
    if name in PER_ROW:
        assert len(rows) == spark.read.parquet(f"{odd}/documents.parquet").count()
        if "held_out" in got.columns:
            assert all(r["held_out"] is not None for r in rows)
        if "score" in got.columns and name != "op10_katz":
            assert all(0 <= r["score"] <= 1 for r in rows)
        groups = {}
        for r in rows:
            groups.setdefault(r["doc_id"], []).append(r)
        assert None in groups
    if name == "op6_main_text":
        assert len(rows) == spark.read.parquet(f"{odd}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert queries.QUERIES[name](spark, empty).count() == 0
