"""Runs a query and its SQL side by side and compares all values."""

import glob
import os

import duckdb
import numpy as np


def level(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(level(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return "nan" if v != v else round(float(v), 7) + 0.0
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return v


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(names, data, order):
    return sorted(repr(tuple(level(r[names.index(c)]) for c in order)) for r in data)


def differences(spark, con, query, sql, folder):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()], sorted(df.columns))
    run = con.execute(sql)
    names = [c[0] for c in run.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, run.fetchall(), sorted(names))
    have, wanted = set(got), set(want)
    return [x for x in got if x not in wanted][:3], [x for x in want if x not in have][:3], len(got) - len(want)
