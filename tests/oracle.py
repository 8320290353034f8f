"""Rows of a query and of its SQL, in a form that can be compared."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else int(x) if isinstance(x, bool) else x


def rows_of_sql(sql):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    done = c.execute(sql)
    names = [d[0] for d in done.description]
    by = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([plain(r[i]) for i in by]) for r in done.fetchall())


def rows_of(df):
    by = sorted(df.columns)
    return by, sorted(repr([plain(r[c]) for c in by]) for r in df.collect())
