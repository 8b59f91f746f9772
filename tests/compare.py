"""Run registered queries next to their SQL on the same files and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, run, sql: str | None) -> tuple[bool, str]:
    df = run(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got_rows) > 0, f"rows={len(got_rows)} (no SQL)"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = bag(df.columns, got_rows), bag(names, want_rows)
    if got == want:
        return True, f"rows={len(got_rows)}"
    return False, (
        f"rows {len(got_rows)} vs {len(want_rows)}; columns {sorted(names)}; "
        f"only spark {list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}"
    )


def main() -> None:
    import __spark_entry__ as entry
    from causalrisk import build_session

    folder = sys.argv[1]
    chosen = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if chosen and not any(c in name for c in chosen):
            continue
        start = time.perf_counter()
        try:
            ok, note = compare(spark, con, folder, run, oracles.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.perf_counter() - start:6.2f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
