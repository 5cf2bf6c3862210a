"""Every registered plan against its SQL, on the smallest data."""

import math

import duckdb
import pytest

from skarn.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(map(plain, (r[c] for c in sorted(df.columns)))) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = db.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = [tuple(map(plain, (r[cols.index(c)] for c in sorted(cols)))) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
