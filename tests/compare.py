"""Run queries against their DuckDB oracle: python tests/compare.py [folder] [prefix ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from emberfield.sources.bindings import TABLES

SMALL = "/root/testdata/sf0.01"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def kind(series: pd.Series) -> str:
    return {"i": "number", "u": "number", "f": "number", "b": "bool"}.get(series.dtype.kind, "other")


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple(cell(v) for v in row))
    return sorted(rows, key=repr)


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(cell(x) for x in v)
    text = str(v)
    return text[:-9] if text.endswith(" 00:00:00") else text


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        names = sorted(got.columns)
        for x, y in zip(a, b):
            if x != y:
                return f"first difference {[(n, p, q) for n, p, q in zip(names, x, y) if p != q]} in {x}"
    return None


def main() -> int:
    from emberfield.session import build_session
    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            spent = time.time() - start
            if name in oracles:
                start = time.time()
                problem = difference(got, con.execute(oracles[name]).df())
                mark = f"oracle {time.time() - start:.1f}s"
            else:
                problem, mark = None, "no oracle"
        except Exception as error:
            problem, mark, spent, got = str(error)[:1500], "ERROR", time.time() - start, []
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name:34s} {spent:5.1f}s {len(got):7d} rows {mark} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
