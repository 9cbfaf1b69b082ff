"""Run registered queries next to their checking SQL and compare the rows.

usage: python tools/check_queries.py [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tarsift.catalog import ORACLES, QUERIES  # noqa: E402
from tarsift.session import build_session  # noqa: E402
from tarsift.views import TABLES  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def compare(spark, db, folder, name):
    """(ok, message, seconds) of one query."""
    began = time.time()
    frame = QUERIES[name](spark, folder)
    got = rows_of(frame.columns, frame.collect())
    spent = time.time() - began
    if name not in ORACLES:
        return True, f"{len(got)} rows, no SQL", spent
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(columns)}", spent
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} vs {len(want)} rows; only here {extra}; only SQL {missing}", spent
    return True, f"{len(got)} rows", spent


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(
        "check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, message, spent = compare(spark, db, folder, name)
        except Exception as error:  # keep going: one report for all queries
            ok, message, spent = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {spent:6.2f}s  {message[:900]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
