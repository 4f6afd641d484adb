"""Run queries() against oracle_sql() at one scale and print a table.

usage: python tests/run_oracles.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from _oracle import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from gleaner.session import build_session, checkpoint_root  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    con = duck(a.sf)
    qs, sqls = E.queries(), E.oracle_sql()
    names = a.names or sorted(E.library_queries())  # the corpus queries are compared in tests/llm
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, a.sf)
            if n in sqls:
                ok, msg = compare(df, con, sqls[n])
            else:
                ok, msg = True, f"no oracle, {df.count()} rows"
        except Exception as exc:  # report and continue
            ok, msg = False, f"ERROR {type(exc).__name__}: {str(exc)[:400]}"
            traceback.print_exc(limit=3)
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:28s} {time.time() - t0:6.1f}s  {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
