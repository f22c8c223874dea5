"""Every registered query against its SQL on the smallest tables; the entry points."""

import glob
import os

import pytest

import __spark_entry__ as entry
from lodestone.plans.oracle import ORACLE_SQL
from lodestone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(rows, names):
    order = sorted(names)
    shown = lambda v: "NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[names.index(c)]) for c in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert plain(got, df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
