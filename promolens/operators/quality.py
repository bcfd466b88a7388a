"""Input checks and preparation jobs (the DDL constraints re-aimed as jobs).

Row counts, keys and NULLs of a table come from one scan of it, shared by four
checks; references are anti joins of counted keys, co-partitioned where the
stored layout buckets both sides. Per-table results are small and are stacked
with ``unionByName``.

Keys: Q01 pk_uniqueness, Q02 fk_orphans, Q03 not_null_violations,
Q04 null_profile, Q05 table_profile, Q06 distinct_profile,
Q07 name_type_drift, Q08 load_clean, Q09 distinct_on, Q10 status_domain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DOCUMENTED_STATUSES, pct
from ..plans.materialize import materialize
from ..sources.schemas import NOT_NULL_COLUMNS, PRIMARY_KEYS, RAW_SCHEMAS
from ..sources.raw import midnight_date
from ..sources.tables import Tables

# Nullable columns, whose NULL share is profiled (Q04): all that the schemas declare.
NULLABLE_PROFILE = {name: tuple(f.name for f in schema.fields if f.nullable)
                    for name, schema in RAW_SCHEMAS.items()
                    if any(f.nullable for f in schema.fields)}
# Columns whose value shares are profiled (Q06); product_name is a label with
# few distinct values per many rows, not a key.
CATEGORICAL_PROFILE = {
    "raw_website_sessions": ("device_type",),
    "raw_products": ("category", "product_name"),
    "raw_campaigns": ("campaign_type",),
}


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _keys_and_nulls(name: str, df: DataFrame) -> DataFrame:
    """One row: rows, keys and NULLs of every column of a table.

    What is shuffled is one row per key and mask of NULL columns, not a count per column; one mask of each key is marked to count keys.
    """
    cols = [f.name for f in RAW_SCHEMAS[name].fields]
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(cols)]
    masks = (df.select(F.col(PRIMARY_KEYS[name]).alias("k"), reduce(lambda x, y: x.bitwiseOR(y), bits).alias("mask"))
             .groupBy("k", "mask").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.lit(0)))))

    def rows(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    nulls = [F.struct(F.lit(c).alias("column_name"), rows(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).alias("n")) for i, c in enumerate(cols)]
    return masks.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                     F.count(F.when((F.col("nth") == 1) & F.col("k").isNotNull(), 1)).alias("n_distinct"),
                     rows(F.col("k").isNull()).alias("n_null"), F.array(*nulls).alias("nulls"))


def profile(t: Tables) -> DataFrame:
    """(table_name, n_rows, n_distinct, n_null, nulls): rows, keys and NULLs of every column, one scan per table.

    Stored once per bundle (seven rows); the row counts, key checks, NOT NULL checks and the NULL profile read it.
    ``nulls`` is an array of (column_name, n).
    """
    return t.shared("profile", lambda: materialize(_stack([_keys_and_nulls(name, df) for name, df in t.as_dict().items()]), "profile"))


def pk_uniqueness(t: Tables) -> DataFrame:
    """Q01: rows, distinct and NULL primary keys per table."""
    return profile(t).select("table_name", "n_rows", "n_distinct", "n_null")


def fk_orphans(t: Tables) -> DataFrame:
    """Q02: child rows whose parent key is missing (declared and implied references).

    Child rows are counted per key before the anti-join, so a hot key is one row there. Session
    order keys that are no number refer to nothing and are a relation of their own.
    """
    def orphans(rel: str, child: DataFrame, ck: str, parent: DataFrame, pk: str,
                key: Column | None = None) -> DataFrame:
        c = child.select((key if key is not None else F.col(ck)).alias("_k")).where(F.col("_k").isNotNull())
        p = parent.select(F.col(pk).alias("_k"))
        per_key = c.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
        return per_key.join(p, "_k", "left_anti").agg(
            F.lit(rel).alias("relation"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_orphans"))
    return _stack([
        orphans("order_items.order_id -> orders", t.order_items, "order_id", t.orders, "order_id"),
        orphans("product_campaign.campaign_id -> campaigns", t.product_campaign, "campaign_id",
                t.campaigns, "campaign_id"),
        orphans("session_activities.session_id -> website_sessions", t.session_activities, "session_id",
                t.website_sessions, "session_id"),
        orphans("order_items.product_id -> products", t.order_items, "product_id", t.products, "product_id"),
        orphans("orders.campaign_id -> campaigns", t.orders, "campaign_id", t.campaigns, "campaign_id"),
        orphans("website_sessions.campaign_id -> campaigns", t.website_sessions, "campaign_id",
                t.campaigns, "campaign_id"),
        orphans("website_sessions.order_id -> orders", t.website_sessions, "order_id", t.orders, "order_id",
                key=F.col("order_id").try_cast("long")),
        t.website_sessions.agg(
            F.lit("website_sessions.order_id not a number").alias("relation"),
            F.count(F.when(F.col("order_id").isNotNull() & F.col("order_id").try_cast("long").isNull(), 1))
            .alias("n_orphans")),
    ])


def _null_counts(t: Tables, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """(table_name, column_name, n_null, _n) of the given columns, from the stored profile."""
    wanted = reduce(lambda x, y: x | y, [(F.col("table_name") == name) & F.col("column_name").isin(*cols) for name, cols in columns.items()])
    return (profile(t).select("table_name", F.col("n_rows").alias("_n"), F.explode("nulls").alias("c"))
            .select("table_name", "c.column_name", F.col("c.n").alias("n_null"), "_n").where(wanted))


def not_null_violations(t: Tables) -> DataFrame:
    """Q03: NULLs in NOT NULL columns."""
    return _null_counts(t, NOT_NULL_COLUMNS).drop("_n")


def null_profile(t: Tables) -> DataFrame:
    """Q04: NULL share of every nullable column, in percent."""
    return _null_counts(t, NULLABLE_PROFILE).select("table_name", "column_name", pct("n_null", "_n", 2).alias("null_pct"))


def table_profile(t: Tables) -> DataFrame:
    """Q05: row count per raw table."""
    return profile(t).select("table_name", "n_rows")


def distinct_profile(t: Tables) -> DataFrame:
    """Q06: value shares of categorical columns."""
    d = t.as_dict()
    frames = []
    for name, cols in CATEGORICAL_PROFILE.items():
        for c in cols:
            frames.append(d[name].groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
                          .select(F.lit(f"{name}.{c}").alias("column_name"), "value", "n"))
    x = _stack(frames)
    # Per-column totals: one row per profiled column (a fixed list), so the
    # join is a broadcast and no column's values meet in one task.
    totals = F.broadcast(x.groupBy("column_name").agg(F.sum("n").alias("_total")))
    return x.join(totals, "column_name").select("column_name", "value", "n",
                                                pct("n", "_total", 2).alias("pct"))


def name_type_drift(t: Tables) -> DataFrame:
    """Q07: campaign names that ran under more than one type."""
    g = t.campaigns.groupBy("campaign_name").agg(
        F.count_distinct("campaign_type").alias("n_types"),
        F.count_distinct(F.year("start_date")).alias("n_years"))
    return g.where(F.col("n_types") > 1)


def load_clean(raw_orders_text: DataFrame) -> DataFrame:
    """Q08 core: parse 'yyyy-MM-dd 00:00:00' text to DATE and drop the redundant columns."""
    return (raw_orders_text
            .withColumn("order_date", midnight_date(F.col("order_date")))
            .drop("order_day", "year_month"))


def load_clean_orders(t_orders_source: DataFrame) -> DataFrame:
    """Q08: the export form of the orders (date text with a midnight suffix plus the
    redundant day and month columns), cleaned back to (order_id, order_date)."""
    exported = t_orders_source.select(
        F.col("o_orderkey").alias("order_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
        F.date_format("o_orderdate", "EEEE").alias("order_day"),
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
    return load_clean(exported).select("order_id", "order_date")


def distinct_on(df: DataFrame, keys: list[str], order_by: list[str], cols: list[str]) -> DataFrame:
    """First row per key by ``order_by`` ascending (``DISTINCT ON``), keeping ``cols``.

    A ``min`` over a struct led by the ordering columns: a partial aggregate,
    so a key with a huge number of rows never lands whole in one task (a
    ``row_number`` window would put it there). Spark runs it as a sort-based
    aggregate (struct buffers are not hash-aggregatable), but each map task
    still emits one row per key before the single shuffle; a hash-only form
    (min per key, join back, min again) would shuffle the whole table for
    the join. Ordering columns are taken as non-NULL; ties on them go to the
    smaller remaining columns.
    """
    rest = [c for c in cols if c not in keys and c not in order_by]
    first = F.min(F.struct(*[F.col(c) for c in order_by + rest])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c)
                                                       for c in cols if c not in keys])


def first_order_per_customer(t: Tables) -> DataFrame:
    """Q09: each customer's first order by (order_date, order_id)."""
    return distinct_on(t.orders, ["customer_id"], ["order_date", "order_id"],
                       ["customer_id", "order_id", "order_date"])


def status_domain(t: Tables) -> DataFrame:
    """Q10: items per status, flagging values outside the documented list."""
    g = t.order_items.groupBy("item_status").agg(F.count(F.lit(1)).alias("n"))
    return g.select("item_status", "n",
                    F.coalesce(F.col("item_status").isin(*DOCUMENTED_STATUSES), F.lit(False))
                    .alias("in_domain"))
