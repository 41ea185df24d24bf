"""Comparing a query with its SQL on DuckDB."""

import glob
import os

import duckdb


def connect(folder):
    engine = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return engine


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return str([normal(x) for x in value])
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def same_rows(engine, sql, df):
    cursor = engine.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())
