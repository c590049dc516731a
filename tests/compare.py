"""Run a query and its SQL on the same tables and compare the rows."""

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value as both engines give it."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def by_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def by_sql(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    have = [d[0] for d in got.description]
    names = sorted(have)
    at = [have.index(c) for c in names]
    return names, Counter(tuple(plain(r[k]) for k in at) for r in got.fetchall())


def differences(df, sql, sf_dir, show=3):
    """A few words on what differs, or the empty string."""
    (a, x), (b, y) = by_spark(df), by_sql(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if x == y:
        return ""
    return f"rows {sum(x.values())} and {sum(y.values())}; only here {list((x - y).items())[:show]}; only in SQL {list((y - x).items())[:show]}"
