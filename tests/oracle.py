"""Compares a Spark result with a DuckDB result on the same Parquet tables."""

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _kind(field):
    text = str(field.type)
    return {"large_string": "string", "timestamp[us]": "timestamp"}.get(text, text)


def compare(df, db, sql):
    """A list of differences; empty when names, types and rows agree."""
    got, want = df.toArrow(), db.sql(sql).to_arrow_table()
    problems = []
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {got.column_names} != {want.column_names}"]
    for name in got.column_names:
        mine, theirs = _kind(got.schema.field(name)), _kind(want.schema.field(name))
        if mine != theirs:
            problems.append(f"type of {name}: {mine} != {theirs}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} != {want.num_rows}")
    names = sorted(got.column_names)
    rows = [sorted(zip(*[map(repr, t.column(n).to_pylist()) for n in names])) for t in (got, want)]
    if rows[0] != rows[1]:
        odd = [pair for pair in zip(*rows) if pair[0] != pair[1]][:2]
        problems.append(f"values differ, first: {odd}")
    return problems
