"""Run registered queries against their SQL counterpart in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb

VERBOSE = False
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, Decimal):
        return str(int(v)) if v == v.to_integral_value() else repr(round(float(v), 5))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 5))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """None when equal, else a description of the first difference."""
    t0 = time.time()
    got_cols, got = rows_of(df.columns, [tuple(r.values()) for r in df.toArrow().to_pylist()])
    t1 = time.time()
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if VERBOSE:
        print(f"    spark {t1 - t0:.1f}s duckdb {time.time() - t1:.1f}s")
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} vs {w}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    odd = [
        f"{n}:{k}/{types[n]}" for n, k in df.dtypes
        if (k, types[n]) not in {
            ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"),
            ("boolean", "BOOLEAN"), ("date", "DATE"), ("tinyint", "TINYINT"), ("smallint", "SMALLINT"),
        }
    ]
    return f"types {odd}" if odd else None


def main(argv: list[str]) -> None:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from pairsift.session import local_session

    global VERBOSE
    VERBOSE = True
    spark = local_session(8)
    folder = argv[0]
    con = connect(folder)
    qs, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, folder)
            if n in oracle:
                res = compare(df, con, oracle[n])
            else:
                res = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__} {str(e)[:600]}"
        if res is not None and not res.startswith("rows only"):
            bad += 1
        print(f"{n:40s} {time.time() - t0:6.2f}s {'ok' if res is None else res}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
