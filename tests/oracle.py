"""Runs a query and its SQL over the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def same(spark_df, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(spark_df.columns)
    cols = sorted(names)
    a = sorted(repr([plain(r[c]) for c in cols]) for r in spark_df.collect())
    b = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cursor.fetchall())
    assert a == b, ([x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    return len(a)
