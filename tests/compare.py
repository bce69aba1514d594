"""Run a query next to its DuckDB twin and compare rows regardless of order."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if value != 0 else 0.0
    if isinstance(value, int):
        return value
    return str(value)


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> tuple[str, float, float]:
    started = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    spark_time = time.time() - started
    if sql is None:
        return (f"rows={len(rows)}" if rows else "EMPTY"), spark_time, 0.0
    con = con or connect(sf_dir)
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    expected = result.fetchall()
    duck_time = time.time() - started
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} duck={sorted(names)}", spark_time, duck_time
    left, right = _bag(df.columns, rows), _bag(names, expected)
    bad = [f"{n}:{t}" for n, t in zip(names, types) if t in ("HUGEINT",) or t.startswith("DECIMAL")]
    note = f" TYPES {bad}" if bad else ""
    if left == right:
        return (f"ok rows={len(rows)}{note}" if rows else "EMPTY both"), spark_time, duck_time
    extra, missing = left - right, right - left
    sample = f"\n   spark only: {list(extra)[:2]}\n   duck only:  {list(missing)[:2]}\n   cols: {sorted(names)}"
    return (
        f"DIFF spark={len(rows)} duck={len(expected)} extra={sum(extra.values())} missing={sum(missing.values())}"
        f"{note}{sample}"
    ), spark_time, duck_time


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from quantframe.session import get_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_session("compare")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            note, a, b = compare(spark, f"/root/testdata/sf{sf}", name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            note, a, b = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0.0, 0.0
        flag = "" if note.startswith(("ok", "rows")) else "!! "
        print(f"{flag}{name}: {note} [spark {a:.1f}s duck {b:.1f}s]", flush=True)
