"""Runs registered queries and their SQL side by side.

    python -m tests.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as contract
from cohortry.session import local_session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "pages", "benchmark",
          "labels", "conversations"]


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _sorted(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    got = _sorted(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = _sorted(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return None if not bad else f"{len(bad)} of {len(got)} rows, first {bad[0][0]} vs {bad[0][1]}"


def main(base: str, names: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(base), contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, base)
            if name in sqls:
                result = difference(df, con, sqls[name]) or "ok"
            else:
                result = f"no SQL, {len(df.collect())} rows"
        except Exception as e:  # report and go on
            result = f"error {type(e).__name__}: {str(e)[:600]}"
        failed += not (result == "ok" or result.startswith("no SQL"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:]))
