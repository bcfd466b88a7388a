"""Typed definitions of the seven raw input tables.

Column names, order and types follow the input contract of the campaign
analytics project (orders, campaigns, order items, enrolments, products,
website sessions, session activities). Keys are widened to ``long`` so that
both the source layout (INT) and the test tables (bigint) fit.
Primary keys, foreign keys and NOT NULL are not enforced by Spark; they are
checked by the jobs in :mod:`promolens.operators.quality`.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY_14 = T.DecimalType(14, 2)
MONEY_12 = T.DecimalType(12, 2)
MONEY_10 = T.DecimalType(10, 2)
PERCENT = T.DecimalType(6, 2)
RATE = T.DecimalType(6, 4)
WEIGHT = T.DecimalType(8, 3)


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


ORDERS = T.StructType([
    _f("order_id", T.LongType(), False),
    _f("order_date", T.DateType(), False),
    _f("customer_id", T.StringType(), False),
    _f("subtotal_amount", MONEY_14),
    _f("shipping_fee_total", MONEY_10),
    _f("commission_total", MONEY_12),
    _f("maintenance_total", MONEY_12),
    _f("total_amount", MONEY_14),
    _f("campaign_id", T.StringType()),          # no value: an order outside campaigns
])

CAMPAIGNS = T.StructType([
    _f("campaign_id", T.StringType(), False),
    _f("campaign_name", T.StringType()),
    _f("start_date", T.DateType()),
    _f("end_date", T.DateType()),
    _f("campaign_type", T.StringType()),        # changes per year for one name
])

ORDER_ITEMS = T.StructType([
    _f("order_item_id", T.LongType(), False),
    _f("order_id", T.LongType(), False),
    _f("product_id", T.StringType(), False),
    _f("quantity", T.IntegerType()),
    _f("unit_price", MONEY_12),
    _f("unit_price_after_discount", MONEY_12),
    _f("line_total", MONEY_14),                 # the GMV measure
    _f("discount_percent", PERCENT),
    _f("commission_amount", MONEY_12),
    _f("maintenance_amount", MONEY_12),
    _f("shipping_fee_item", MONEY_10),
    _f("estimated_delivery_start", T.DateType()),
    _f("estimated_delivery_end", T.DateType()),
    _f("item_status", T.StringType()),          # one of the three documented statuses
    _f("is_campaign", T.ShortType()),           # not to be relied on by itself
    _f("product_campaign_id", T.StringType()),  # NULL = not enrolled
])

PRODUCT_CAMPAIGN = T.StructType([
    _f("product_campaign_id", T.StringType(), False),
    _f("product_id", T.StringType(), False),
    _f("campaign_id", T.StringType(), False),
    _f("discount_percent", PERCENT),
])

PRODUCTS = T.StructType([
    _f("product_id", T.StringType(), False),
    _f("seller_id", T.StringType(), False),
    _f("category", T.StringType()),
    _f("product_name", T.StringType()),
    _f("maintenance_rate", RATE),
    _f("commission_rate", RATE),
    _f("weight", WEIGHT),
    _f("created_at", T.DateType()),
])

WEBSITE_SESSIONS = T.StructType([
    _f("session_id", T.StringType(), False),
    _f("user_id", T.StringType(), False),
    _f("session_date", T.DateType(), False),
    _f("session_start_time", T.TimestampNTZType(), False),
    _f("session_end_time", T.TimestampNTZType()),
    _f("utm_source", T.StringType()),
    _f("campaign_id", T.StringType()),          # NULL = non-campaign session
    _f("device_type", T.StringType()),
    _f("order_id", T.StringType()),             # text; NULL = not converted
])

SESSION_ACTIVITIES = T.StructType([
    _f("activity_id", T.LongType(), False),
    _f("session_id", T.StringType(), False),
    _f("page_url", T.StringType(), False),
    _f("session_start_time", T.TimestampNTZType()),
    _f("session_end_time", T.TimestampNTZType()),
])

RAW_SCHEMAS: dict[str, T.StructType] = {
    "raw_orders": ORDERS,
    "raw_campaigns": CAMPAIGNS,
    "raw_order_items": ORDER_ITEMS,
    "raw_product_campaign": PRODUCT_CAMPAIGN,
    "raw_products": PRODUCTS,
    "raw_website_sessions": WEBSITE_SESSIONS,
    "raw_session_activities": SESSION_ACTIVITIES,
}

PRIMARY_KEYS: dict[str, str] = {
    "raw_orders": "order_id",
    "raw_campaigns": "campaign_id",
    "raw_order_items": "order_item_id",
    "raw_product_campaign": "product_campaign_id",
    "raw_products": "product_id",
    "raw_website_sessions": "session_id",
    "raw_session_activities": "activity_id",
}

# NOT NULL columns other than the primary key.
NOT_NULL_COLUMNS: dict[str, tuple[str, ...]] = {
    "raw_orders": ("order_date", "customer_id"),
    "raw_order_items": ("order_id", "product_id"),
    "raw_product_campaign": ("product_id", "campaign_id"),
    "raw_products": ("seller_id",),
    "raw_website_sessions": ("user_id", "session_date", "session_start_time"),
    "raw_session_activities": ("session_id", "page_url"),
}


def conform_columns(df, schema: T.StructType, fill: bool = False) -> list:
    """Columns of ``df`` cast to ``schema``.

    A missing column is an error; with ``fill`` (only for the mapping of the
    test tables, which lack some) it becomes typed NULLs.
    """
    from pyspark.sql import functions as F

    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing and not fill:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cols = []
    for field in schema.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return cols


def conform(df, schema: T.StructType, fill: bool = False):
    """Select and cast ``df`` to ``schema``."""
    return df.select(*conform_columns(df, schema, fill))
