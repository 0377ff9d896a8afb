"""Comparison of a query with its SQL, insensitive to order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings invoices purchase_orders contracts evidence_items raw_records given_names".split()


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def key(row):
    return tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


def compare(df, sql, d):
    columns = sorted(df.columns)
    ours = sorted(key([r[c] for c in columns]) for r in df.collect())
    res = connect(d).sql(sql)
    names = list(res.columns)
    assert sorted(names) == columns
    theirs = sorted(key([r[names.index(c)] for c in columns]) for r in res.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
