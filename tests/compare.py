"""Run a registered query and its DuckDB counterpart over the same tables and compare rows and types."""

import math
from collections import Counter

import duckdb

from siltstone.sources.tables import TABLES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def difference(spark, con, sf_dir, query, sql):
    """What differs, or nothing."""
    df = query(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = dict(zip(names, (str(d[1]) for d in result.description), strict=True))
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    wrong = {n: (k, kinds[n]) for n, k in df.dtypes if KINDS.get(k, k.upper().replace(",", ",")) != kinds[n] and not k.startswith("decimal")}
    if wrong:
        return f"types {wrong}"
    order = sorted(names)
    got = Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    at = [names.index(n) for n in order]
    want = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    if got != want:
        return f"{sum(got.values())} rows and {sum(want.values())}; only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"
    return ""
