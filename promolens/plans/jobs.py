"""Batch job entry point (``spark-submit -m promolens.plans.jobs ...`` or ``python -m``).

Three steps, each optional:

* ``--load-fixture DIR``: map the driver's test tables under DIR to the raw layout
  and store it under ``--raw`` (the load step); with ``--raw-database`` and
  ``--bucket-raw N`` also as catalog tables bucketed by order / session key;
* ``--marts OUT``: build the eight derived tables from ``--raw`` and write them
  as Parquet under OUT (or as catalog tables with ``--database``);
* ``--reports OUT``: run every registered report / quality query and write each
  result as Parquet under OUT/<key>.

The session comes from the environment (cluster settings win); nothing is
collected to the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.marts import save_marts, write_marts
from ..sources import fixture, raw
from .registry import REGISTRY
from .tuning import apply_where_unset, scale_conf


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="promolens")
    ap.add_argument("--raw", help="folder of the raw tables (Parquet layout)")
    ap.add_argument("--raw-database", help="read the raw tables from this catalog database instead")
    ap.add_argument("--bucket-raw", type=int, metavar="N",
                    help="after loading, also store the raw tables in --raw-database, bucketed into N")
    ap.add_argument("--load-fixture", help="driver test-table folder to map into --raw first")
    ap.add_argument("--marts", help="output folder for the derived tables")
    ap.add_argument("--database", help="write the derived tables as catalog tables in this database")
    ap.add_argument("--reports", help="output folder for every registered query")
    ap.add_argument("--only", nargs="*", help="subset of query keys for --reports")
    ap.add_argument("--input-gb", type=float, help="raw input volume, to size shuffle partitions")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("promolens").getOrCreate()
    if args.input_gb:
        cores = spark.sparkContext.defaultParallelism
        apply_where_unset(spark, scale_conf(int(args.input_gb * 1024 ** 3), cores))
    if not (args.raw or args.raw_database):
        ap.error("one of --raw or --raw-database is required")
    if args.load_fixture:
        fixture.write_raw_tables(spark, args.load_fixture, args.raw)
        if args.raw_database and args.bucket_raw:
            raw.save_raw_tables(raw.read_raw(spark, args.raw, with_item_orders=False),
                                args.raw_database, buckets=args.bucket_raw)
    t = raw.read_catalog(spark, args.raw_database) if args.raw_database else raw.read_raw(spark, args.raw)
    if args.database:
        save_marts(t, args.database)
    elif args.marts:
        write_marts(t, args.marts)
    if args.reports:
        for name in args.only or list(REGISTRY):
            REGISTRY[name](t).write.mode("overwrite").parquet(f"{args.reports.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
