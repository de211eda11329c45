"""Compare a query with its SQL: same columns and the same rows in any order."""

import math
import os

import duckdb
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(names, data):
    """Rows as tuples of text, columns by name; NaN counts as null."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    want = duck(sf_dir).sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (len(bad), bad[:3])
