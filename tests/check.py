"""Run queries against their SQL: ``python tests/check.py /root/testdata/sf0.01 [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(folder), 0
    sql = entry.oracle_sql()
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        started = time.perf_counter()
        try:
            if name in sql:
                found = difference(build(spark, folder), connection, sql[name])
            else:
                found = None if build(spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {time.perf_counter() - started:6.2f}s {name}")
        if found:
            print(found)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
