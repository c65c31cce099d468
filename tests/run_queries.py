"""python -m tests.run_queries FOLDER [NAME...]: time, rows and SQL difference of queries."""

from __future__ import annotations

import sys
import time

import __spark_entry__ as e
from glossmill.session import session
from tests.oracle import differences, duck

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = session("run", spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="10g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = duck(folder), e.queries(), e.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                n, diff = differences(df, con, oracle[name])
                print(f"{name}: {n} rows, {time.time() - began:.1f} s, {'EQUAL' if not diff else f'DIFFERENT {diff}'}", flush=True)
            else:
                print(f"{name}: {df.count()} rows, {time.time() - began:.1f} s, no SQL", flush=True)
        except Exception as x:  # noqa: BLE001
            print(f"{name}: FAILED {str(x)[:1500]}", flush=True)
