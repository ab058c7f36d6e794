"""python tests/compare.py [SF_DIR] [NAME...]: all queries against their SQL, with seconds."""

import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import __spark_entry__ as entry  # noqa: E402
from oracle_support import differences, duck  # noqa: E402

from bindloom.session import local_session  # noqa: E402


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = local_session("compare", cores=os.environ.get("TEST_CORES", "8")), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name in args[1:] or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = differences(df, con, sql[name]) if name in sql else f"rows {df.count()}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        fine = not said or said.startswith("rows ") and name not in sql
        bad += not fine
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)" if fine else f"{name}: DIFFERS {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
