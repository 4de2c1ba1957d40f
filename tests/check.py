"""Quick CLI for development: python tests/check.py [name-prefix ...]

Runs the selected registered queries at $TICKETLAKE_TEST_SF (default sf0.01) and
compares each with its oracle, printing one line per query with its time."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import compare, duck  # noqa: E402
from ticketlake.plans.registry import oracle_sql, queries  # noqa: E402
from ticketlake.session import get_session  # noqa: E402


def main(prefixes):
    sf = os.environ.get("TICKETLAKE_TEST_SF", "/root/testdata/sf0.01")
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    q, o = queries(), oracle_sql()
    con = duck(sf)
    bad = 0
    for name in sorted(q):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = q[name](spark, sf)
            if name in o:
                ok, msg = compare(df, con, o[name])
            else:
                n = df.count()
                ok, msg = True, f"{n} rows (no oracle)"
        except Exception as e:  # report and go on
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time() - t:6.2f}s  {msg}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
