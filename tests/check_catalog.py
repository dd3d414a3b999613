"""Run catalog queries against their SQL: python tests/check_catalog.py [sf] [name parts]."""

import sys
import time
from os.path import abspath, dirname

sys.path.insert(0, dirname(dirname(abspath(__file__))))
from ledgersight.catalog import ORACLE, QUERIES  # noqa: E402
from ledgersight.session import build_session  # noqa: E402
from tests.oracle import connect, difference  # noqa: E402

if __name__ == "__main__":
    base = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    parts = sys.argv[2:] or [""]
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(base), 0
    for name, run in QUERIES.items():
        if not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = difference(run(spark, base), con, ORACLE[name])
            else:
                problem = None if run(spark, base).count() else "no rows"
        except Exception as e:  # a report over all queries
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s "
              f"{'' if name in ORACLE else '(rows only) '}{problem or ''}", flush=True)
    print(f"{bad} failed of {len(QUERIES)}")
