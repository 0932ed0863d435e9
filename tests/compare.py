"""Holding a query's rows against SQL that DuckDB runs on the same tables."""

import decimal
import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{files}'")
    return con


def plain(columns, rows):
    """Rows by sorted column names, in a fixed order, numbers rounded."""

    def value(v):
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6)
        return bytes(v) if isinstance(v, bytearray) else v if v is None or isinstance(v, (int, str, bytes)) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(value(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def assert_same(df, sql, folder=SMALL):
    want = connection(folder).sql(sql)
    assert plain(df.columns, df.collect()) == plain(want.columns, want.fetchall())
