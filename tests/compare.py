"""Runs registered queries against their oracle SQL and compares all values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def check(spark, con, query, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query.run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    if query.sql is None:
        return None
    res = con.execute(query.sql)
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    have = {n: types.get(t, t) for n, t in df.dtypes}
    need = {c[0]: str(c[1]) for c in res.description}
    off = {c: (have[c], need[c]) for c in have if have[c] != need[c]}
    if got != want:
        a, b = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} rows vs {sum(want.values())}; only spark {a}; only oracle {b}; types {off}"
    return f"types {off}" if off else None


if __name__ == "__main__":
    from skytrace.plans import QUERIES
    from skytrace.session import local_session

    sf = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = check(spark, con, QUERIES[name], sf)
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {'' if QUERIES[name].sql else '(no oracle)'} {problem or ''}", flush=True)
    print(len(names), "queries,", bad, "bad")
