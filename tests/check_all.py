"""Every registered query against its SQL: ``python tests/check_all.py [folder] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import differences, duck  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master(os.environ.get("CHECK_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(folder), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                found = differences(df, con, sql[name])
                state = "ok" if not found else "DIFF"
            else:
                found, state = [], f"rows {df.count()}"
        except Exception as e:
            found, state = [traceback.format_exc(limit=-3)[-1500:] if os.environ.get("TRACE") else str(e)[:600]], "ERROR"
        bad += bool(found)
        print(f"{state:6} {time.time() - start:6.2f}s {name}", *found[:4], sep="\n       " if found else " ", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
