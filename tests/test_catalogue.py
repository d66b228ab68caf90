"""Each registered query against its SQL on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from kerbline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.01"



@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{DIR}/{name}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    import datetime

    plain = lambda v: v.date() if isinstance(v, datetime.datetime) else v
    got = [{k: plain(v) for k, v in r.asDict().items()} for r in catalogue.queries()[name](spark, DIR).collect()]
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, map(plain, r))) for r in cur.fetchall()]
    key = lambda rs: sorted(repr([(k, r[k]) for k in sorted(r)]) for r in rs)
    assert key(got) == key(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
