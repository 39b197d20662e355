"""Compare a query with its SQL on DuckDB."""

import glob
import math
import os
import re

import duckdb
import numpy as np
import pandas as pd


def connect(d):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canon(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and math.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.integer, np.floating)):
            return float(f"{float(v):.9g}")
        return str(v).replace("+00:00", "")

    df = df[sorted(df.columns)]
    return list(df.columns), [[cell(v) for v in r] for r in df.itertuples(index=False)]


def ordered(sql):
    """Whether the whole of a query is ordered: ORDER BY after the last closing
    bracket but those of its own terms."""
    return re.search(r"ORDER BY [^()]*$", sql.strip()) is not None


def same(spark_df, con, sql):
    """Equal columns and rows; in equal order where the SQL gives one."""
    got, want = canon(spark_df.toPandas()), canon(con.execute(sql).df())
    assert got[0] == want[0]
    if ordered(sql):
        assert got[1] == want[1]
    else:
        assert sorted(got[1], key=str) == sorted(want[1], key=str)
