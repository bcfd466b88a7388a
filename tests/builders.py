"""Hand-made raw tables for unit tests: lists of dicts -> Tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from promolens.sources import schemas as S
from promolens.sources.tables import Tables


def D(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def TS(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def M(x) -> Decimal:
    return Decimal(str(x))


def frame(spark, schema, rows):
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(full, schema)


def item(order_id, amount, status="Completed", n=None, product="P1", commission=0, maintenance=0,
         discount=0, is_campaign=0, pc=None):
    item.seq = getattr(item, "seq", 0) + 1
    return {"order_item_id": n or item.seq, "order_id": order_id, "product_id": product,
            "line_total": M(amount), "item_status": status, "commission_amount": M(commission),
            "maintenance_amount": M(maintenance), "discount_percent": M(discount),
            "is_campaign": is_campaign, "product_campaign_id": pc}


def tables(spark, orders=(), items=(), campaigns=(), products=(), enrol=(), sessions=(), activities=()):
    return Tables(
        orders=frame(spark, S.ORDERS, orders),
        order_items=frame(spark, S.ORDER_ITEMS, items),
        campaigns=frame(spark, S.CAMPAIGNS, campaigns),
        products=frame(spark, S.PRODUCTS, products),
        product_campaign=frame(spark, S.PRODUCT_CAMPAIGN, enrol),
        website_sessions=frame(spark, S.WEBSITE_SESSIONS, sessions),
        session_activities=frame(spark, S.SESSION_ACTIVITIES, activities),
    )


def day_of_items(order_id, date, n_items, amount=100, customer="U1", campaign=None, status="Completed"):
    """One order on ``date`` with ``n_items`` items of ``amount`` each."""
    o = {"order_id": order_id, "order_date": D(date), "customer_id": customer, "campaign_id": campaign}
    its = [item(order_id, amount, status) for _ in range(n_items)]
    return o, its
