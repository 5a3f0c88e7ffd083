"""Compare a Spark result with its SQL on DuckDB, value by value."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, repr(x)) for x in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b and type(a) is type(b)


def differences(df, con, sql):
    """None when equal, else a short description."""
    cols = sorted(df.columns)
    spark_types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    left = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {sorted(names)} against {cols}"
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    if spark_types != duck_types:
        return f"types differ: {spark_types} against {duck_types}"
    at = [names.index(c) for c in cols]
    right = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{dict(zip(cols, a))} against {dict(zip(cols, b))}"
    return None
