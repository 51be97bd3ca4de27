"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from vellum.plans.catalog import QUERIES
    from vellum.plans.verify import compare, duck
    from vellum.session import get_session
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or sorted(QUERIES)
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:300]}"
        bad += ok is False
        print(f"{'----' if ok is None else 'OK  ' if ok else 'FAIL'} {name}: {msg} {time.time() - t0:.1f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
