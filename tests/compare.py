"""Run a query and its SQL on the same parquet tables and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def difference(df, con, sql: str) -> str:
    """Empty when columns, row count and all values agree, else a short description."""
    got_cols = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    types = {d[0]: str(d[1]) for d in found.description}
    if sorted(names) != got_cols:
        return f"columns {got_cols} against {sorted(names)}"
    order = [names.index(c) for c in got_cols]
    want = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    got = Counter(tuple(plain(r[c]) for c in got_cols) for r in df.collect())
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [c for c, t in df.dtypes if t in kinds and types[c] not in (kinds[t], "NUMBER", "STRING", "bool")]
    if odd:
        return f"types {[(c, dict(df.dtypes)[c], types[c]) for c in odd]}"
    if got != want:
        only_got, only_want = got - want, want - got
        return (
            f"{sum(got.values())} rows against {sum(want.values())}; extra {sum(only_got.values())} "
            f"{list(only_got)[:2]}; missing {list(only_want)[:2]}"
        )[:1500]
    return ""
