"""Compare a query with its SQL, run by another engine over the same files."""

import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


def canon(rows):
    plain = lambda x: round(x, 6) if isinstance(x, float) else x if isinstance(x, (int, str, bool, type(None))) else str(x)
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def compare(df, connection, sql):
    columns = sorted(df.columns)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = canon(tuple(r[i] for i in at) for r in result.fetchall())
    got = canon(tuple(r) for r in df.select(*columns).collect())
    assert got == want
