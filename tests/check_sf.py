"""Compare all (or named) registered queries with their SQL: check_sf.py SF_DIR [name ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.compare import compare, connect  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry
    from ledgerloom.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start, counts = time.time(), {}
        try:
            if name in oracle:
                diff = compare(spark, con, sf_dir, queries[name], oracle[name], counts)
            else:
                diff = None
                counts["rows"] = f"{queries[name](spark, sf_dir).count()} (no sql)"
        except Exception as error:  # report and go on
            diff = f"{type(error).__name__}: {str(error)[:1200]}"
            if len(names) == 1:
                traceback.print_exc()
        failed += diff is not None
        print(f"{'FAIL' if diff else 'ok':5}{name:32}{time.time() - start:6.1f}s  {counts.get('rows', '-')}  {diff or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
