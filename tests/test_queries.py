"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from affinity import plans

FOLDER = os.environ.get("AFFINITY_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 9)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, FOLDER)
    rows = sorted([[plain(r[c]) for c in sorted(got.columns)] for r in got.collect()], key=str)
    if name not in plans.oracle_sql():
        assert rows or not got.columns
        return
    found = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted([[plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)] for r in found.fetchall()], key=str)
    assert sorted(names) == sorted(got.columns)
    assert rows == want
