"""Check queries by hand: python tests/run_queries.py [name-prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from watchfold.plans.catalog import QUERIES  # noqa: E402
from watchfold.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8", app="check")
    con = oracle.connect(folder)
    wanted = sys.argv[1:]
    bad = 0
    for name, q in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = q.plan(spark, folder)
            problems = oracle.compare(df, q.sql, con) if q.sql else ([] if df.count() else ["empty"])
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - t:.1f}s {'' if q.sql else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p[:1800])
    print("bad:", bad)
