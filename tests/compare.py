"""Runs a query and its SQL on the same tables and compares all rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(x: object) -> str:
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return f"{float(x) + 0.0:.6f}".replace("-0.000000", "0.000000")
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_plain(x) for x in r) for r in frame.itertuples(index=False, name=None))


def difference(spark_frame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if equal, else what differs."""
    ours = pd.DataFrame([r.asDict() for r in spark_frame.collect()], columns=spark_frame.columns, dtype=object)
    table = con.sql(sql).to_arrow_table()
    theirs = pd.DataFrame({c: table.column(c).to_pylist() for c in table.column_names}, dtype=object)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    kinds = {"long": "bigint", "int64": "bigint", "int32": "int", "int8": "tinyint", "int16": "smallint", "bool": "boolean", "date32[day]": "date", "large_string": "string", "timestamp[us]": "timestamp_ntz"}
    types = {f.name: kinds.get(str(f.type), str(f.type)) for f in table.schema}
    odd = {c: (t, types[c]) for c, t in spark_frame.dtypes if t != types[c] and not (t.startswith("timestamp") and "timestamp" in types[c])}
    a, b = rows(ours), rows(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}"
    return f"types {odd}" if odd else ""
