"""Read and write the seven raw tables in their own layout.

``read_raw`` reads one folder per table (Parquet, explicit schema, no
inference); tables on the order key and on the session key are co-partitioned
(bucketed alike), and the item x order fact is also partitioned by the campaign
flag, so campaign metrics read only the campaign directory; ``read_csv_export``
reads a CSV export and applies the two load fixes of the source DDL (date text
ending in ``00:00:00`` becomes DATE, the redundant ``order_day`` /
``year_month`` columns are dropped); ``write_raw`` stores a bundle, optionally
with the pre-joined item x order fact so later jobs skip the largest join.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.publish import publish, published
from . import schemas as S
from .tables import CAMPAIGN_FLAG, ORDER_COLUMNS, Tables

ITEM_ORDERS = "item_orders"
_FIELDS = {
    "orders": "raw_orders", "order_items": "raw_order_items", "campaigns": "raw_campaigns",
    "products": "raw_products", "product_campaign": "raw_product_campaign",
    "website_sessions": "raw_website_sessions", "session_activities": "raw_session_activities",
}
# Columns of the CSV export that hold dates with a midnight time suffix.
EXPORT_DATE_COLUMNS = {
    "raw_orders": ("order_date",),
    "raw_order_items": ("estimated_delivery_start", "estimated_delivery_end"),
    "raw_campaigns": ("start_date", "end_date"),
    "raw_products": ("created_at",),
    "raw_website_sessions": ("session_date",),
}
EXPORT_DROPPED_COLUMNS = ("order_day", "year_month")


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


# Bucketing keys of the stored layout: tables joined or grouped on the same
# key share it, so those joins and aggregates need no shuffle.
BUCKET_KEYS = {
    "raw_orders": "order_id",
    "raw_order_items": "order_id",
    ITEM_ORDERS: "order_id",
    "raw_website_sessions": "session_id",
    "raw_session_activities": "session_id",
}
#: Catalog database in which the bucketed folders are known to the session.
LAYOUT_DB = "promolens_layout"
#: A key may fill this many average buckets, or hold this many rows, before its table is stored without buckets.
HOT_BUCKETS, HOT_ROWS = 4, 100_000


def default_buckets(spark: SparkSession) -> int:
    """An eighth of the shuffle partitions: a bucket is read by one task, and holds all columns."""
    return min(65_536, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def _even(tables: dict[str, DataFrame], buckets: int) -> set[str]:
    """The tables of ``BUCKET_KEYS`` none of whose keys would fill a bucket by itself (a hot order, a bot session)."""
    sizes = []
    for name, df in tables.items():
        per_key = df.groupBy(F.col(BUCKET_KEYS[name]).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        sizes.append(per_key.agg(F.lit(name).alias("name"), F.max("n").alias("most"), F.sum("n").alias("all")))
    rows = reduce(lambda x, y: x.unionByName(y), sizes).collect()          # one row a table
    return {r["name"] for r in rows if (r["most"] or 0) <= max(HOT_ROWS, HOT_BUCKETS * (r["all"] or 0) // buckets)}


def _write_plain(df: DataFrame):
    return lambda path: df.write.mode("overwrite").parquet(path)


def _write_bucketed(df: DataFrame, key: str, buckets: int, partition: str | None = None):
    """Bucketed and sorted files; the catalog entry that the writer needs is dropped again (the files stay)."""
    def write(path: str) -> None:
        spark = df.sparkSession
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {LAYOUT_DB}")
        name = f"{LAYOUT_DB}.writing_{uuid.uuid4().hex}"
        w = df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
        try:
            (w.partitionBy(partition) if partition else w).saveAsTable(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return write


def write_raw(t: Tables, root: str, with_item_orders: bool = True, mode: str = "overwrite",
              parallel: int = 4, buckets: int | None = None) -> None:
    """Store the raw tables (and the item x order fact) under ``root``, all or none of them.

    Orders, items and their join are bucketed by ``order_id``, sessions and activities by ``session_id``, into the
    same number of buckets (``buckets``; 0 for none, default :func:`default_buckets`), unless one key holds so many
    rows that its bucket would be one long task. The item x order fact is also partitioned by the campaign
    flag: one file per bucket and flag, so the few campaign rows do not leave a tiny file per task.
    """
    spark = t.spark
    n = default_buckets(spark) if buckets is None else buckets
    frames = {name: getattr(t, attr) for attr, name in _FIELDS.items()}
    if with_item_orders:
        frames[ITEM_ORDERS] = t.item_orders().withColumn(CAMPAIGN_FLAG, F.col("campaign_id").isNotNull())
    even = _even({k: df for k, df in frames.items() if k in BUCKET_KEYS}, n) if n else set()
    writes = {}
    for name, df in frames.items():
        if name in even:
            writes[name] = _write_bucketed(df, BUCKET_KEYS[name], n, CAMPAIGN_FLAG if name == ITEM_ORDERS else None)
        elif name == ITEM_ORDERS:
            writes[name] = _write_by_flag(df)
        else:
            writes[name] = _write_plain(df)
    publish(spark, root, writes, {name: {"buckets": n} for name in sorted(even)}, mode, parallel)


def _write_by_flag(io: DataFrame):
    """Partition folders by the campaign flag; a rebalance lets AQE size the few campaign files."""
    def write(path: str) -> None:
        flag = F.col(CAMPAIGN_FLAG)
        for value, part in (("true", io.where(flag).hint("rebalance")), ("false", io.where(~flag))):
            part.drop(CAMPAIGN_FLAG).write.mode("overwrite").parquet(f"{path}/{CAMPAIGN_FLAG}={value}")
    return write


def _registered(spark: SparkSession, root: str, name: str, schema: T.StructType, ident: str, buckets: int) -> DataFrame:
    """A bucketed folder as an external table, so that Spark knows its buckets."""
    table = f"{LAYOUT_DB}.{name}_{ident[:16]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {LAYOUT_DB}")
    if not spark.catalog.tableExists(table):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        key, parts = BUCKET_KEYS[name], CAMPAIGN_FLAG in schema.fieldNames()
        spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet {f'PARTITIONED BY ({CAMPAIGN_FLAG})' if parts else ''} "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{_path(root, name)}'")
        if parts:
            spark.catalog.recoverPartitions(table)
    return spark.table(table)


def read_raw(spark: SparkSession, root: str, with_item_orders: bool = True) -> Tables:
    known = published(spark, root) or {}
    buckets = {name: x["buckets"] for name, x in known.get("layout", {}).items()}

    def stored(name: str, schema: T.StructType) -> DataFrame:
        if name in buckets:
            return _registered(spark, root, name, schema, known["id"], buckets[name])
        return spark.read.schema(schema).parquet(_path(root, name))

    frames = {attr: stored(name, S.RAW_SCHEMAS[name]) for attr, name in _FIELDS.items()}
    item_orders = None
    if with_item_orders:
        schema = T.StructType(S.ORDER_ITEMS.fields
                              + [T.StructField(c, S.ORDERS[c].dataType, True) for c in ORDER_COLUMNS]
                              + [T.StructField(CAMPAIGN_FLAG, T.BooleanType(), True)])
        try:
            item_orders = stored(ITEM_ORDERS, schema)
        except AnalysisException as e:  # folder absent: metrics build the join themselves
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            item_orders = None
    return Tables(**frames, item_orders_df=item_orders)


def midnight_date(c: Column) -> Column:
    """'yyyy-MM-dd' or 'yyyy-MM-dd 00:00:00' text as a DATE; any other text stops the load."""
    text = c.cast("string")
    day = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}( 00:00:00)?$"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    return F.when(text.isNotNull(), F.coalesce(day, F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")))


def clean_export(df: DataFrame, date_columns: tuple[str, ...]) -> DataFrame:
    """Parse 'yyyy-MM-dd[ 00:00:00]' text columns to DATE and drop redundant columns."""
    for c in date_columns:
        if c in df.columns:
            df = df.withColumn(c, midnight_date(F.col(c)))
    return df.drop(*[c for c in EXPORT_DROPPED_COLUMNS if c in df.columns])


def read_csv_export(spark: SparkSession, root: str, header: bool = True) -> Tables:
    """Read one CSV folder per raw table (all columns as text), clean and type them."""
    frames = {}
    for attr, name in _FIELDS.items():
        text = spark.read.option("header", header).csv(_path(root, name))
        cleaned = clean_export(text, EXPORT_DATE_COLUMNS.get(name, ()))
        frames[attr] = S.conform(cleaned, S.RAW_SCHEMAS[name])
    return Tables(**frames)


def use_schema(spark: SparkSession, database: str, create: bool = False) -> None:
    """``SET search_path TO database``: make ``database`` the current catalog database."""
    if create:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.catalog.setCurrentDatabase(database)


def save_raw_tables(t: Tables, database: str | None = None, mode: str = "overwrite",
                    buckets: int | None = None) -> None:
    """Store the raw tables as catalog tables (in ``database`` if given).

    With ``buckets``, orders and order items are bucketed (and sorted) by
    ``order_id`` and sessions and activities by ``session_id`` into the same
    number of buckets: the item -> order join, the per-order aggregates, the
    activity -> session aggregation and join then run without an exchange.
    Size ``buckets`` to the data (e.g. a few thousand for 100 TB).
    """
    spark = t.spark
    if database:
        use_schema(spark, database, create=True)
    for attr, name in _FIELDS.items():
        w = getattr(t, attr).write.mode(mode)
        if buckets and name in BUCKET_KEYS:
            w = w.bucketBy(buckets, BUCKET_KEYS[name]).sortBy(BUCKET_KEYS[name])
        w.saveAsTable(name)


def read_catalog(spark: SparkSession, database: str | None = None) -> Tables:
    """The raw tables from the catalog (``spark.table``), typed to the raw schemas."""
    if database:
        use_schema(spark, database)
    frames = {attr: S.conform(spark.table(name), S.RAW_SCHEMAS[name]) for attr, name in _FIELDS.items()}
    return Tables(**frames)
