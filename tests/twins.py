"""The given tables and the comparison of results that the tests share."""

import math
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def views(folder):
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS FROM '{folder}/{file}'")
    return con


def cells(df):
    """Sorted rows of a pandas frame in a form that both engines share."""
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cooked = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                cooked.append("~")
            elif isinstance(v, bool) or not isinstance(v, (int, float)):
                cooked.append(str(v))
            else:
                cooked.append(repr(float(v)))
        out.append(tuple(cooked))
    return sorted(out)
