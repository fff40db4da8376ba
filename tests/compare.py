"""Spark queries against their SQL in DuckDB."""

import math


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else int(v) if hasattr(v, "__int__") and not isinstance(v, (str, float, bool)) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, folder):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = query(spark, folder)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not wrong, wrong[:3]
    return len(a[1])
