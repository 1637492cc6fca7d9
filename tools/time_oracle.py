"""Seconds of each catalog query's SQL in DuckDB (8 threads, rows fetched), as a yardstick.

usage: python tools/time_oracle.py [sf_dir]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from claimlens.oracle import ORACLE_SQL  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        start = time.perf_counter()
        con.execute(sql).fetchall()
        print(f"{name}\t{time.perf_counter() - start:.2f}")


if __name__ == "__main__":
    main()
