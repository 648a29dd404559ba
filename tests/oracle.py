"""Runs a query and its SQL over the same tables and compares all values."""

import os

import duckdb
from pyspark.sql import functions as F  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def compare(df, sql, folder):
    names, want = rows_of_sql(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(w[names.index(c)] for c in order) for w in want), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
