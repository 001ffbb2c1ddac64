"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import glob
import os

import duckdb


def connect(d):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(d + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and x != x) or str(x) in ("<NA>", "NaT"):
        return "null"
    return f"{float(x):.9g}" if isinstance(x, float) or type(x).__name__.startswith(("int", "float")) else str(x)


def table_rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_cell(x) for x in r) for r in pdf.astype(object).itertuples(index=False, name=None))


def agree(spark, con, query, sql, d):
    ours, theirs = query(spark, d).toPandas(), con.execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert table_rows(ours) == table_rows(theirs)
