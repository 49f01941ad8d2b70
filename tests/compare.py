"""Runs a registered query and its SQL over the same tables."""

import math
import pathlib
from collections import Counter

import duckdb

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, folder, name):
    con = duckdb.connect()
    for p in pathlib.Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want
    assert got
