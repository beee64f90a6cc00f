"""Runs every query beside its SQL. ``python -m battery.compare [sf_dir] [name part ..]``"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    """A value in the form both engines share."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def sort_key(row):
    return tuple((v is not None, str(type(v).__name__), v) if not isinstance(v, (int, float))
                 else (True, "n", round(v, 4)) for v in row)


def compare(left, left_names, right, right_names) -> str:
    """'' when equal, else the first difference. Rows are compared without order."""
    if sorted(left_names) != sorted(right_names):
        return f"columns {sorted(left_names)} != {sorted(right_names)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    names = sorted(left_names)
    a = sorted(([plain(r[left_names.index(n)]) for n in names] for r in left), key=sort_key)
    b = sorted(([plain(r[right_names.index(n)]) for n in names] for r in right), key=sort_key)
    loose = 0
    for x, y in zip(a, b):
        if x == y:
            continue
        for n, u, v in zip(names, x, y):
            if u == v:
                continue
            if isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(
                u, v, rel_tol=1e-9, abs_tol=2e-6
            ):
                loose += 1
                continue
            return f"{n}: {u!r} != {v!r} in {dict(zip(names, x))}"
    return f"~ {loose} last digits differ" if loose else ""


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def run(spark, con, sf_dir: str, name: str) -> tuple[str, float, int]:
    from battery import ORACLE, QUERIES

    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLE:
        return "no sql", took, len(rows)
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    return compare(rows, df.columns, cursor.fetchall(), names), took, len(rows)


def main() -> int:
    from bench import session
    from battery import QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, bad = session(), duck(sf_dir), 0
    for name in QUERIES:
        if args and not any(a in name for a in args):
            continue
        try:
            verdict, took, rows = run(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - the run goes on to the next query
            verdict, took, rows = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, 0
        fine = verdict in ("", "no sql") or verdict.startswith("~")
        bad += not fine
        print(f"{'ok ' if fine else 'BAD'} {name:42s} {took:6.2f}s {rows:7d} rows  {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
