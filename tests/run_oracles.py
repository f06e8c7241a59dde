"""python tests/run_oracles.py [sf] [name-prefix ...] — compare queries with their SQL twins."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from scholia.session import build_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                out = compare(spark, con, sf_dir, fn, oracles[name])
            else:
                n = len(fn(spark, sf_dir).collect())
                out = "" if n else "EMPTY"
        except Exception as exc:  # report and go on with the next query
            text = str(exc)
            out = "ERROR " + (text if len(text) < 1500 else text[:1500])
            if os.environ.get("TRACE"):
                traceback.print_exc()
        took = time.time() - start
        bad += bool(out)
        if out or took > 5 or os.environ.get("VERBOSE"):
            print(f"{name:28s} {took:6.2f}s {'rows-only ' if name not in oracles else ''}{out or 'ok'}", flush=True)
    print("queries", sum(n.startswith(prefixes) for n in queries), "bad", bad)


if __name__ == "__main__":
    main()
