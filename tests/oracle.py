"""Side-by-side comparison with DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return x


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def expected(c, sql: str):
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    columns = sorted(names)
    return columns, sorted((tuple(plain(r[names.index(n)]) for n in columns) for r in got.fetchall()), key=repr)
