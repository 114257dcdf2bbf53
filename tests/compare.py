"""Run queries next to their DuckDB oracles: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailquarry.plans import fixtures, queries  # noqa: E402


def session(cores: str = "8", memory: str = "8g") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("mailquarry")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind == "f":
            df[c] = df[c].map(lambda v: "NULL" if pd.isna(v) else repr(float(v) + 0.0))
        elif kind == "b":
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].map(lambda v: "NULL" if v is None or (isinstance(v, float) and pd.isna(v)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(df[c].dtype.kind, "other") for c in df.columns}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} <> {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    if len(got) and kinds(got) != kinds(want):
        return "types " + str({c: (kinds(got)[c], kinds(want)[c]) for c in got.columns if kinds(got)[c] != kinds(want)[c]})
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return None
    bad = {c: int((a[c] != b[c]).sum()) for c in a.columns if not a[c].equals(b[c])}
    i = next(i for i in range(len(a)) if not a.iloc[i].equals(b.iloc[i]))
    return f"values {bad}\n   got  {a.iloc[i].to_dict()}\n   want {b.iloc[i].to_dict()}"


def check(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> tuple[str | None, int, float, float]:
    t0 = time.time()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    t1 = time.time()
    if name not in queries.ORACLES:
        return None, len(got), t1 - t0, 0.0
    want = con.execute(queries.ORACLES[name]).df()
    return difference(got, want), len(got), t1 - t0, time.time() - t1


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, bad = session(), duck(sf_dir), []
    for name in names or list(queries.QUERIES):
        try:
            diff, n, a, b = check(spark, con, name, sf_dir)
        except Exception as e:
            diff, n, a, b = "error " + str(e)[:1200], -1, 0.0, 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        mark = "ok" if diff is None else "BAD"
        print(f"{mark:4} {name:26} rows={n:6} spark={a:6.2f}s duck={b:6.2f}s {'' if name in queries.ORACLES else '(rows only)'}", flush=True)
        if diff:
            bad.append(name)
            print("   ", diff[:1800], flush=True)
    print(f"{len(bad)} bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    sys.exit(min(main(folder, args), 1))
