"""Every query of the catalogue against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from axonframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    want = db.sql(catalogue.SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_serials_of_more_than_six_digits(spark, tmp_path):
    """Keys of up to eight digits keep all of them in their serials; the next serials go on from the greatest."""
    keys = [1, 2, 3, 999_999, 1_000_000, 1_000_001, 1_234_566, 1_234_567, 12_345_678, 12_345_675]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.SQL["assign_serial"]).fetchall())
    got = sorted((r["_id"], r["serial_id"]) for r in catalogue.QUERIES["assign_serial"](spark, str(tmp_path)).collect())
    assert got == want and (1_000_001, "1000001") in got
