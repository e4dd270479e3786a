"""Time the headline queries: one JSON line on standard output.

Each query runs once to warm the JVM and then `BENCH_RUNS` times; the best run counts.
Every row of a result is produced (`noop` sink), staging included.

Each given table is one file of one row group, which only one task can read. Before any query is timed, the
tables are copied into `BENCH_FILES` files each (0 leaves them as they are), as a table of any size would stand there.
"""

from __future__ import annotations

import json
import os
import time

from linemend.queries import ALL
from linemend.queries.tables import TABLES
from linemend.session import drop_work_dir, get_session, work_dir

HEADLINE = (
    "typed_lineitem",
    "repaired_lineitem",
    "broken_lineitem",
    "repair_documents",
    "reject_overflow",
    "file_status",
    "inflate_archives",
    "convert_archives",
    "registry_parse",
    "catalog_rows",
    "district_table",
    "level_counts",
    "verify_codes",
    "download_items",
    "schema_table",
    "encoding_audit",
    "profile_all",
    "lookup_by_key",
)


def dealt(spark, folder: str, files: int) -> str:
    """A copy of the tables in a number of files each, rows in their order."""
    copy = work_dir(spark, "bench")
    for name in TABLES:
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        if (first := rows.columns[0]) and rows.count() >= 1000:
            rows = rows.repartitionByRange(files, first).sortWithinPartitions(first)
        rows.write.parquet(f"{copy}/{name}.parquet")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("OFF")
    files = int(os.environ.get("BENCH_FILES", "16"))
    source = dealt(spark, folder, files) if files else folder
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            ALL[name][0](spark, source).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "files": files,
    }
    if source != folder:
        drop_work_dir(spark, source)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
