"""Every catalogue query that has SQL equals DuckDB at the smallest scale."""

import datetime
import decimal
import os

import pytest

from quarryline.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float("%.7g" % float(v))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_equals_sql(spark, duck, name):
    f, sql = CATALOG[name]
    df = f(spark, SF)
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert mine == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
