"""Rows of two engines as comparable text."""

import glob
import math
import os


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v) + 0.0:.6f}"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in values)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con
