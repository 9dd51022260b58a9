"""Results of a query and of its SQL in one form."""

import decimal
import glob
import math
import os

import duckdb


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    got = [tuple(_plain(x) for x in r) for r in frame.astype(object).where(frame.notna(), None).values.tolist()]
    return list(frame.columns), sorted(got, key=repr)


def oracle(sql, folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c.execute(sql).df()
