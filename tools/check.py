"""Compare registered queries with their SQL in DuckDB: python tools/check.py [prefix ...] [--sf 0.01]."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
INTS = {"tinyint", "smallint", "int", "integer", "bigint", "hugeint", "int32", "int64"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(rows: list[tuple], cols: list[str]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def norm(v):
        if isinstance(v, float) and v != v:
            return "NaN"
        if isinstance(v, bool):
            return str(v)
        return repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def kind(name: str) -> str:
    n = name.lower()
    if n in {"varchar", "string"}:
        return "string"
    if n in {"int", "integer"}:
        return "int32"
    return n


def compare(spark, con, sf_dir: str, q) -> tuple[str, str]:
    df = q.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows"
    rel = con.sql(q.sql)
    want, wcols = rel.fetchall(), rel.columns
    types = {c: kind(str(t)) for c, t in zip(wcols, rel.types)}
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    if sorted(wcols) != sorted(df.columns):
        return "COLS", f"{sorted(df.columns)} vs {sorted(wcols)}"
    a, b = canon(got, df.columns), canon(want, wcols)
    if len(a) != len(b):
        return "COUNT", f"{len(a)} vs {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return "VALUES", f"{len(bad)} differ, first {bad[0]}"
    if types != mine:
        diff = {c: (mine[c], types[c]) for c in mine if mine[c] != types[c]}
        return "TYPES", str(diff)
    if not got:
        return "EMPTY", "0 rows"
    return "ok", f"{len(a)} rows"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("prefix", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--verbose", action="store_true")
    args = ap.parse_args()
    from exprlake.plans.catalog import REGISTRY
    from exprlake.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "8g", "spark.sql.codegen.wholeStage": "true",
                                "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in REGISTRY.items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        t0 = time.time()
        try:
            status, detail = compare(spark, con, sf_dir, q)
        except Exception as exc:  # noqa: BLE001
            status, detail = "ERROR", str(exc).strip()[:600]
            if args.verbose:
                traceback.print_exc()
        bad += status not in ("ok", "rows")
        print(f"{status:7s} {name:45s} {time.time() - t0:6.2f}s {detail}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    pd.set_option("display.width", 200)
    raise SystemExit(1 if main() else 0)
