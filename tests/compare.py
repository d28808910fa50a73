"""Compares a query with its SQL on the same tables, as multisets of rows."""

from pathlib import Path

import duckdb


def _cell(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return str([_cell(x) for x in v])
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(_cell(r[i]) for i in at) for r in cur.fetchall()), key=repr)
