"""Run a registered query and its SQL twin and compare whole results."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def compare(df, sql, con):
    """Empty list if equal, else a few words on each difference."""
    rel = con.sql(sql)
    want_cols, want = rel.columns, rel.fetchall()
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    problems = []
    if sorted(want_cols) != sorted(got_cols):
        return [f"columns {sorted(got_cols)} want {sorted(want_cols)}"]
    want_types = dict(zip(want_cols, map(str, rel.types)))
    for name, t in df.dtypes:
        if _TYPES.get(t, t) != want_types[name]:
            problems.append(f"type of {name}: {t} want {want_types[name]}")
    if len(want) != len(got):
        problems.append(f"{len(got)} rows want {len(want)}")
    if not want:
        problems.append("no rows to compare")
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {bad[0]} over {sorted(got_cols)}")
    return problems
