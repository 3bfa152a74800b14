"""Every query with SQL gives what DuckDB gives over the same tables."""

import glob
import os

import numpy as np
import pytest

from tidegauge.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
#: Checked by the driver at a larger scale; too slow, or empty, on the smallest tables.
SKIPPED = {"split_walk_forward"}


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str).str[:19]
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v)[:10] if hasattr(v, "year") else v)
    df = df.replace({"NaT": None})
    key = lambda s: s.map(lambda v: "" if v is None or v != v else f"{v:.6e}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True, key=key)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SKIPPED))
def test_oracle(spark, duck, data, name):
    a, b = _norm(QUERIES[name](spark, data).toPandas()), _norm(duck.execute(ORACLES[name]).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind in "fiu" and y.dtype.kind in "fiu":
            assert np.allclose(x.astype(float), y.astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert ((x == y) | (x.isna() & y.isna())).all(), c


@pytest.mark.parametrize("customers", [[-5, 0, None, 32767], [-40000, 0, None, 32768, 65536, 899999]])
def test_rename_and_cast_of_wide_keys(spark, tmp_path, customers):
    """Where a customer is beyond SMALLINT, DuckDB's strict cast has no result; all other columns are compared then."""
    spark.createDataFrame([(i, c, 10.75 + i) for i, c in enumerate(customers)], "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    sql, fits = ORACLES["rename_and_cast"], max(c or 0 for c in customers) < 2**15
    if not fits:
        with pytest.raises(duckdb.ConversionException):
            con.execute(sql).fetchall()
        assert sql.count("SMALLINT") == 1
        sql = sql.replace("SMALLINT", "BIGINT")
    got = QUERIES["rename_and_cast"](spark, str(tmp_path))
    assert dict(got.dtypes)["cust_int16"] == ("smallint" if fits else "int") and dict(got.dtypes)["cust_u16"] == "int"
    want = con.execute(sql)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
