"""Comparison of a query with its SQL."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    columns = sorted(frame.columns)

    def text(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return columns, sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False))


def compare_with_sql(spark, run, sql, sf_dir=SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    got, want = rows_of(run(spark, sf_dir).toPandas()), rows_of(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
