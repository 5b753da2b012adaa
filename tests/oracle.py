"""Compare a query's rows with those of its SQL, whatever their order."""

import math
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def _rows(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def same(df, con, sql):
    cursor = con.execute(sql)
    names, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = _rows(df.columns, df.collect())
    assert got == _rows(names, want)
    return len(got)
