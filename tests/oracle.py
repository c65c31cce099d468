"""Compare a Spark result with the result of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    """A value that compares alike from either engine."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or hasattr(x, "isoformat"):
        return str(x)
    if isinstance(x, int):
        return float(x)
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(plain(v) for v in x)
    try:
        return float(f"{float(x):.9g}") if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def duck(folder: str):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def differences(spark_df, con, sql: str) -> tuple[int, list]:
    """(rows in Spark, rows that one side has more often)."""
    got = spark_df.collect()
    columns = sorted(spark_df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in got)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns, (sorted(names), columns)
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    return len(got), list((ours - theirs).items())[:5] + list((theirs - ours).items())[:5]
