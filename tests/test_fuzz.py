"""Differential test on random raw tables full of awkward rows.

The same rows go to Spark (the builders) and to DuckDB (the oracle statements,
run directly on ``raw_*`` tables instead of the test-table mapping): NULL
statuses, amounts and categories, unknown statuses, orphan items, campaigns
and sessions, duplicate keys, NULL / zero / negative session lengths,
non-numeric order keys, mixed-case URLs, campaign ids without a campaign.
"""

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import types as T

from builders import tables
from oracle_harness import compare
from promolens.plans.oracle import Q
from promolens.plans.registry import REGISTRY
from promolens.sources import schemas as S


def duck_type(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT",
            T.StringType: "VARCHAR", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP"}[type(t)]


def money(rnd, hi=500_000, null_share=0.03):
    return None if rnd.random() < null_share else Decimal(rnd.randint(0, hi)) / 100


def generate(seed: int, campaign_share: float = 0.35, n_sessions: int = 45,
             n_activities: int = 140) -> dict[str, list[dict]]:
    rnd = random.Random(seed)
    camps = []
    for i in range(6):
        start = dt.date(2022 + i % 3, rnd.choice([4, 9, 10, 11, 12]), rnd.randint(1, 20))
        camps.append({"campaign_id": f"C{i}", "campaign_name": rnd.choice(["A Sale", "B Sale", "C Sale"]),
                      "campaign_type": rnd.choice(["discount", "bundle", "voucher", "flash-sale"]),
                      "start_date": start, "end_date": start + dt.timedelta(days=rnd.choice([0, 0, 2]))})
    products = [{"product_id": f"P{i}", "seller_id": f"S{i % 4}",
                 "category": rnd.choice(["Home", "Tech", "Food", None])} for i in range(12)]
    enrol = [{"product_campaign_id": f"E{i}",
              "product_id": rnd.choice(products)["product_id"] if rnd.random() < 0.9 else "PX",
              "campaign_id": rnd.choice(camps)["campaign_id"],
              "discount_percent": money(rnd, 5000, 0.1)} for i in range(20)]
    base_days = [dt.date(2022 + rnd.randint(0, 2), rnd.randint(1, 12), rnd.randint(1, 28)) for _ in range(6)]
    orders = []
    for i in range(70):
        if rnd.random() < campaign_share:
            c = rnd.choice(camps)
            cid = c["campaign_id"] if rnd.random() < 0.9 else "CX"
            day = c["start_date"]
        else:
            cid, day = None, rnd.choice(base_days)
        orders.append({"order_id": i if rnd.random() < 0.97 else i - 1, "order_date": day,
                       "customer_id": f"U{rnd.randint(0, 20)}", "campaign_id": cid})
    items = []
    for _ in range(260):
        items.append({"order_item_id": rnd.randint(0, 250), "order_id": rnd.randint(0, 74),
                      "product_id": rnd.choice(products)["product_id"] if rnd.random() < 0.95 else "PX",
                      "line_total": money(rnd), "discount_percent": money(rnd, 9000, 0.05),
                      "commission_amount": money(rnd, 9000), "maintenance_amount": money(rnd, 3000),
                      "item_status": rnd.choice(["Completed"] * 6 + ["Cancelled", "Refunded", None, "Lost"]),
                      "is_campaign": rnd.choice([0, 1]), "product_campaign_id": rnd.choice([None, None, "E1"])})
    sessions, acts = [], []
    base = dt.datetime(2023, 5, 1, 9, 0, 0)
    for i in range(n_sessions):
        start = base + dt.timedelta(minutes=rnd.randint(0, 10_000))
        end = rnd.choice([None, start, start - dt.timedelta(seconds=90),
                          start + dt.timedelta(microseconds=rnd.randint(1, 4_000_000_000))])
        sessions.append({"session_id": f"S{i if rnd.random() < 0.95 else i - 1}", "user_id": f"V{i}",
                         "session_date": start.date(), "session_start_time": start, "session_end_time": end,
                         "campaign_id": rnd.choice([None, None, "C0", "C1", "C2", "CX"]),
                         "device_type": rnd.choice(["Mobile", "Desktop", None]),
                         "order_id": rnd.choice([None, None, str(rnd.randint(0, 80)), "x12", " 7"])})
    urls = ["/Home", "/product/9", "/CART", "/checkout", "/Billing", "/thank-you", "/product/cart-cover", "/other"]
    for i in range(n_activities):
        acts.append({"activity_id": i, "session_id": f"S{rnd.randint(0, 50)}", "page_url": rnd.choice(urls)})
    return {"orders": orders, "items": items, "campaigns": camps, "products": products, "enrol": enrol,
            "sessions": sessions, "activities": acts}


NAMES = {"orders": ("raw_orders", S.ORDERS), "items": ("raw_order_items", S.ORDER_ITEMS),
         "campaigns": ("raw_campaigns", S.CAMPAIGNS), "products": ("raw_products", S.PRODUCTS),
         "enrol": ("raw_product_campaign", S.PRODUCT_CAMPAIGN),
         "sessions": ("raw_website_sessions", S.WEBSITE_SESSIONS),
         "activities": ("raw_session_activities", S.SESSION_ACTIVITIES)}


def duck_tables(data) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for key, (name, schema) in NAMES.items():
        cols = ", ".join(f"{f.name} {duck_type(f.dataType)}" for f in schema.fields)
        con.execute(f"CREATE TABLE {name} ({cols})")
        rows = [tuple(r.get(f.name) for f in schema.fields) for r in data[key]]
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(schema.fields))})", rows)
    return con


@pytest.fixture(scope="module", params=[1, 2, 3, 4, "empty"])
def fuzz(spark, request):
    # "empty": no campaign orders, no sessions, no activities (degenerate groups).
    data = generate(5, 0.0, 0, 0) if request.param == "empty" else generate(request.param)
    t = tables(spark, orders=data["orders"], items=data["items"], campaigns=data["campaigns"],
               products=data["products"], enrol=data["enrol"], sessions=data["sessions"],
               activities=data["activities"])
    return t, duck_tables(data)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_random_rows_match_oracle(fuzz, name):
    t, con = fuzz
    r = compare(REGISTRY[name](t), con, Q[name])
    assert r["match"], r


@pytest.mark.parametrize("name", ["category_order_value", "category_share", "fact_category_performance",
                                  "session_duration", "fact_funnel"])
def test_random_rows_match_oracle_radix(fuzz, name, monkeypatch):
    from promolens.functions import percentile
    monkeypatch.setattr(percentile, "MAP_MAX_KEYS", 0)
    t, con = fuzz
    t._cache.pop(("shared", "session_masks"), None)
    r = compare(REGISTRY[name](t), con, Q[name])
    assert r["match"], r


@pytest.fixture(scope="module")
def fuzz_stored(spark):
    """Random rows written to the stored raw layout (campaign-partitioned fact) and read back."""
    import tempfile

    from promolens.sources import raw
    data = generate(6)
    t = tables(spark, orders=data["orders"], items=data["items"], campaigns=data["campaigns"],
               products=data["products"], enrol=data["enrol"], sessions=data["sessions"],
               activities=data["activities"])
    root = tempfile.mkdtemp(prefix="promolens-fuzz-raw-")
    raw.write_raw(t, root)
    return raw.read_raw(spark, root), duck_tables(data)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_random_rows_stored_layout_match_oracle(fuzz_stored, name):
    t, con = fuzz_stored
    r = compare(REGISTRY[name](t), con, Q[name])
    assert r["match"], r


@pytest.mark.parametrize("name", list(REGISTRY))
def test_random_rows_sort_merge_joins_match_oracle(spark, name, monkeypatch):
    """Random rows with every unbounded join as a sort-merge join (NULL keys travel through shuffles)."""
    from promolens.plans import joins
    monkeypatch.setattr(joins, "DEFAULT_BROADCAST_ROWS", 3)
    data = generate(7)
    t = tables(spark, orders=data["orders"], items=data["items"], campaigns=data["campaigns"],
               products=data["products"], enrol=data["enrol"], sessions=data["sessions"],
               activities=data["activities"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = compare(REGISTRY[name](t), duck_tables(data), Q[name])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert r["match"], r
