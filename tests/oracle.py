"""Compare a query's rows with DuckDB's for its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


def differences(df, folder: str, sql: str) -> list[str]:
    cur = connect(folder).execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} are not {sorted(names)}"]
    cols = sorted(names)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if len(want) != len(have):
        return [f"{len(have)} rows, not {len(want)}"]
    close = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5)
    return [f"{h} is not {w}" for h, w in zip(have, want, strict=True) if not all(map(close, h, w))][:5]
