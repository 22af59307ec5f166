"""Compares queries with their SQL: python tests/compare.py [FOLDER] NAME..."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x


def rows(frame: pd.DataFrame) -> list:
    cols = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


def same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if equal, else what differs."""
    a, b = spark_df.toPandas(), con.sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows(a), rows(b)
    if x != y:
        sx, sy = set(map(repr, x)), set(map(repr, y))
        return f"rows {len(x)} and {len(y)}; only Spark {sorted(sx - sy)[:3]}; only SQL {sorted(sy - sx)[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e
    from tessera.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    q, sql = e.queries(), e.oracle_sql()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = views(folder)
    bad = 0
    for name in [n for n in q if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]:
        t = time.time()
        try:
            df = q[name](spark, folder)
            said = same(df, con, sql[name]) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as x:
            said = f"ERROR {str(x)[:1500]}"
        bad += name in sql and bool(said)
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
    print("differing:", bad)
