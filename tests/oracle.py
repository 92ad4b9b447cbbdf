"""Compare a query's rows with DuckDB's."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir) -> str | None:
    """None if the rows agree, else what differs."""
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows_of(names, cur.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return None
    odd = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:3]
    return f"{len(got)} and {len(want)} rows; {odd}"
