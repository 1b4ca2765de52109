"""Compares a registered query with its SQL on the same Parquet files."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        return int(x)
    if isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        return plain(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if type(x).__name__ == "Decimal":
        return plain(float(x))
    if isinstance(x, bool):
        return int(x)
    return x


def difference(spark_df, con, sql: str) -> str:
    """Empty if equal: columns, and rows as a multiset."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    order = sorted(range(len(names)), key=names.__getitem__)
    want = Counter(tuple(plain(r[k]) for k in order) for r in got.fetchall())
    mine = Counter(tuple(plain(r[n]) for n in sorted(names)) for r in spark_df.collect())
    if want == mine:
        return ""
    return f"{sum(mine.values())} and {sum(want.values())} rows; only in Spark {list((mine - want).items())[:3]}; only in SQL {list((want - mine).items())[:3]}"
