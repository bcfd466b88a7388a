"""Benchmark: every registered query at one scale factor, one JSON line out.

Production shape: a load step maps the driver tables to the seven raw tables
(plus the item x order fact) and writes them once; then every metric, mart
and quality job runs against the stored tables, its rows written to nowhere.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma-separated subset).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from promolens.plans.registry import REGISTRY, SOURCE_QUERIES  # noqa: E402
from promolens.session import local_session  # noqa: E402
from promolens.sources import fixture, raw  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    subset = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(f"local[{cpus}]", "promolens-bench",
                          **{"spark.sql.shuffle.partitions": str(2 * cpus),
                             "spark.driver.memory": "16g"})
    scratch = tempfile.mkdtemp(prefix="promolens-bench-")
    # JVM warm-up on a trivial job so that no measured step pays for it.
    spark.range(1000).selectExpr("sum(id)").collect()

    t0 = time.perf_counter()
    fixture.write_raw_tables(spark, sf_dir, scratch)
    load_sec = time.perf_counter() - t0
    tables = raw.read_raw(spark, scratch)

    # Warm-up of the query path (a first read of a stored table, none that queries share); not timed.
    tables.products.groupBy("category").count().collect()

    times: dict[str, float] = {"load_raw_tables": round(load_sec, 3)}
    names = [*REGISTRY, *SOURCE_QUERIES]
    for name in names:
        if subset and name not in subset:
            continue
        t = time.perf_counter()
        df = REGISTRY[name](tables) if name in REGISTRY else SOURCE_QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec_all_queries", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
