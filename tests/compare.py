"""Compare a query's rows in Spark with its SQL's rows in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(plain(r[k]) for k in order) for r in data]
    return sorted(out, key=repr)


def duck(sf_dir, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = c.execute(sql)
    return [x[0] for x in got.description], got.fetchall()


def difference(df, sf_dir, sql):
    """None if the two agree; else what differs."""
    names, data = duck(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, data)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b) if x != y), None)
