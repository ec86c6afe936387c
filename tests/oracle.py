"""Runs registered queries in Spark and their SQL in DuckDB and compares the results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata")


def connect(directory: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory / table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if hasattr(value, "as_tuple"):
        return f"decimal {value}"
    return value


def order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, name: str, directory: Path) -> tuple[str, float, float]:
    t0 = time.time()
    df = entry.queries()[name](spark, str(directory))
    rows = [r.asDict() for r in df.collect()]
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(rows)}", t1 - t0, 0.0
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    t2 = time.time()
    if sorted(df.columns) != sorted(names):
        return f"BAD columns {sorted(df.columns)} vs {sorted(names)}", t1 - t0, t2 - t1
    columns = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=order)
    b = sorted((tuple(plain(r[c]) for c in columns) for r in theirs), key=order)
    if len(a) != len(b):
        return f"BAD rows {len(a)} vs {len(b)}; e.g. {columns} {set(a) - set(b) and sorted(set(a) - set(b), key=order)[:2]} vs {sorted(set(b) - set(a), key=order)[:2]}", t1 - t0, t2 - t1
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if bad:
        return f"BAD values {len(bad)} of {len(a)}: {columns} {bad[0][0]} vs {bad[0][1]}", t1 - t0, t2 - t1
    return f"ok {len(a)}" + ("" if a else " EMPTY"), t1 - t0, t2 - t1


def main() -> None:
    from paritas.session import session

    scale = sys.argv[1]
    wanted = sys.argv[2:]
    spark = session()
    con = connect(DATA / scale)
    names = [n for n in entry.queries() if not wanted or any(n == w or n.startswith(w + "_") or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    bad = 0
    for name in names:
        try:
            verdict, spark_s, duck_s = compare(spark, con, name, DATA / scale)
        except Exception as e:  # noqa: BLE001
            verdict, spark_s, duck_s = f"BAD {type(e).__name__} {str(e)[:600]}", 0.0, 0.0
        bad += verdict.startswith("BAD")
        print(f"{name:36s} {spark_s:6.2f}s {duck_s:6.2f}s {verdict[:900]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
