"""Times the SQL of the headline queries in DuckDB: median of three warm runs and rows, as a Markdown table.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.
"""

from __future__ import annotations

import os
import time
from statistics import median

import duckdb

from bench import HEADLINE
from panelweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    con = duckdb.connect()
    con.sql(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    known = catalogue.oracle_sql()
    print("| query | DuckDB s | rows out |\n|---|---|---|")
    for name in [n for n in HEADLINE if n in known]:
        took, rows = [], 0
        for _ in range(4):
            began = time.perf_counter()
            rows = len(con.sql(known[name]).fetchall())
            took.append(time.perf_counter() - began)
        print(f"| {name} | {median(took[1:]):.3f} | {rows} |")


if __name__ == "__main__":
    main()
