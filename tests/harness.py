"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wayfold.fixtures import BASE  # noqa: E402


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(f"local[{cores}]").appName("wayfold-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(normal(r[i]) for i in order) for r in rows]
    return names, sorted(data, key=repr)


def compare(df, con, sql):
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        only_g = list(set(map(repr, got)) - set(map(repr, want)))[:3]
        only_w = list(set(map(repr, want)) - set(map(repr, got)))[:3]
        return f"rows {len(got)} != {len(want)}; only spark {only_g}; only sql {only_w}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. {got_names} {bad[0]}", len(got)
    return "", len(got)


def main(argv):
    import __spark_entry__ as entry

    sf = "/root/testdata/" + (os.environ.get("SF") or "sf0.01")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    spark, con = session(), duck(sf)
    failed = []
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            if n in oracle:
                problem, count = compare(df, con, oracle[n])
            else:
                problem, count = "", len(df.collect())
        except Exception as e:  # report and go on
            problem, count = f"{type(e).__name__}: {str(e)[:700]}", -1
        state = "FAIL" if problem else ("ok" if n in oracle else "rows")
        print(f"{state:5} {n:34} {count:8} rows {time.time() - t:6.1f}s {problem}", flush=True)
        if problem:
            failed.append(n)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
