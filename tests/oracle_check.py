"""Compare a query with its SQL twin, column by column, without regard to row order."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*'}')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else (round(v, 9) + 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, sf: str) -> str:
    c = connect(sf)
    cur = c.execute(sql)
    oc, orows = rows_of([d[0] for d in cur.description], cur.fetchall())
    sc, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if oc != sc:
        return f"columns {sc} and {oc}"
    if len(orows) != len(srows):
        return f"{len(srows)} and {len(orows)} rows"
    bad = [(a, b) for a, b in zip(srows, orows) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""
