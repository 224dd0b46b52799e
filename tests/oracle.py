"""Runs a query and its DuckDB SQL on the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    answer = con.sql(sql)
    names = answer.columns
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(str(row[i]) for i in order) for row in answer.fetchall())
    assert got == want
