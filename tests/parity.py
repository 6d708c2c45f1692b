"""Spark rows against DuckDB rows, columns by name, rows in any order."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str = SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def rows(found, columns):
    def plain(x):
        if x is None or x != x:
            return ""
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in found)


def same(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect(), columns)
    con = duck(sf_dir)
    wanted = con.execute(f"select {', '.join(columns)} from ({sql})").fetchall()
    assert sorted(c[0] for c in con.execute(f"describe ({sql})").fetchall()) == columns
    return got, rows(wanted, columns)
