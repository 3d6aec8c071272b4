"""Run registered queries in Spark and their SQL in DuckDB, and compare every row.

usage: python tools/compare.py FOLDER [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from citeloom.queries.catalog import REGISTRY  # noqa: E402
from citeloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if value is not None and type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> str:
    entry = REGISTRY[name]
    t0 = time.time()
    df = entry.run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if entry.sql is None:
        return f"ROWS {name}: {len(got)} rows, {t1 - t0:.1f}s"
    res = con.execute(entry.sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(names)}"
    if got == want:
        return f"ok   {name}: {note}" + ("" if got else "  (EMPTY)")
    diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return f"FAIL {name}: {note}, sql rows {len(want)}\n  columns {sorted(names)}\n" + "\n".join(f"  spark {a}\n  sql   {b}" for a, b in diff)


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names or REGISTRY:
        try:
            print(compare(spark, con, folder, name), flush=True)
        except Exception as exc:  # noqa: BLE001
            print(f"ERR  {name}: {str(exc)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
