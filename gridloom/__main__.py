"""python -m gridloom NAME --data DIR: runs a grid query, times it, and can write a report and a sample."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from gridloom import queries
from gridloom.sources.sinks import write_report

log = logging.getLogger("gridloom")


def main(argv: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    options.add_argument("name", nargs="?", help="a query; without one, all names are listed")
    options.add_argument("--data", default=".", help="folder of the Parquet tables")
    options.add_argument("--master", default="local[*]")
    options.add_argument("--show", type=int, default=10, help="rows to show")
    options.add_argument("--repeat", type=int, default=1)
    options.add_argument("--explain", action="store_true", help="print the plan instead of running it")
    options.add_argument("--report", help="JSON file for times and rows")
    chosen = options.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    known = queries.queries()
    if chosen.name is None:
        print("\n".join(sorted(known)))
        return 0
    if chosen.name not in known:
        log.error("no query is named %s", chosen.name)
        return 2
    spark = SparkSession.builder.master(chosen.master).appName("gridloom").getOrCreate()
    if chosen.explain:
        known[chosen.name](spark, chosen.data).explain("formatted")
        return 0
    seconds, rows = [], 0
    for _ in range(max(1, chosen.repeat)):
        start = time.perf_counter()
        frame = known[chosen.name](spark, chosen.data)
        rows = frame.count()
        seconds.append(round(time.perf_counter() - start, 3))
        log.info("%s: %d rows in %.3f s", chosen.name, rows, seconds[-1])
    frame.show(chosen.show)
    if chosen.report:
        write_report(chosen.report, {"query": chosen.name, "data": chosen.data, "rows": rows, "seconds": seconds})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
