"""Comparing a Spark result with DuckDB's answer on the same Parquet files."""

import math
from glob import glob
from os.path import basename

import duckdb


def connect(base):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob(f"{base}/*.parquet"):
        con.execute(f"CREATE VIEW {basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def value_key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, float(v)) if isinstance(v, float) else (2, v)
    return (3, str(v))


def difference(df, con, sql, tolerance=0.0):
    """None when equal, else a description. Types must match, not only values."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if kinds.get(kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(value_key(r[i]) for i in order) for r in want))
    got = sorted(tuple(value_key(v) for v in r) for r in df.select(*sorted(names)).collect())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            same = a == b or (a[0] == b[0] == 2 and abs(a[1] - b[1]) <= tolerance)
            if not same:
                return f"{sorted(names)}: {g} != {w}"
    return None
