"""Hot keys: results stay exact when one key holds most rows (checked by brute force)."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from builders import D, M, item, tables
from promolens.functions import percentile
from promolens.operators import campaigns as C
from promolens.operators import customers as U
from promolens.operators import sessions as S

CAMP = {"campaign_id": "C1", "campaign_name": "9.9 Sale", "campaign_type": "voucher",
        "start_date": D("2024-09-09"), "end_date": D("2024-09-09")}


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    orders, items, sessions, acts = [], [], [], []
    # One hot customer with 120 orders over many days; 30 ordinary customers.
    for i in range(120):
        orders.append({"order_id": i, "order_date": D("2024-09-01") + dt.timedelta(days=i % 20),
                       "customer_id": "HOT", "campaign_id": "C1" if i % 20 == 8 else None})
    for c in range(30):
        orders.append({"order_id": 1000 + c, "order_date": D("2024-09-01") + dt.timedelta(days=c % 15),
                       "customer_id": f"U{c}", "campaign_id": "C1" if c % 15 == 8 else None})
    # One hot order with 150 items; the rest one to three items.
    for k in range(150):
        items.append(item(8, rnd.randint(1, 500), rnd.choice(["Completed", "Cancelled"])))
    for o in orders:
        if o["order_id"] != 8:
            for _ in range(rnd.randint(1, 3)):
                items.append(item(o["order_id"], rnd.randint(1, 500)))
    # 200 campaign sessions, most without an order; one bot session with 400 activities.
    base = dt.datetime(2024, 9, 9, 10, 0, 0)
    aid = 0
    for s in range(200):
        order = str(8 if s % 10 == 0 else 1008) if s % 5 == 0 else None
        sessions.append({"session_id": f"S{s}", "user_id": f"V{s}", "session_date": D("2024-09-09"),
                         "session_start_time": base,
                         "session_end_time": base + dt.timedelta(seconds=rnd.randint(1, 5000)),
                         "campaign_id": "C1" if s % 2 == 0 else None, "order_id": order})
        n_act = 400 if s == 0 else rnd.randint(1, 3)
        for _ in range(n_act):
            acts.append({"activity_id": aid, "session_id": f"S{s}",
                         "page_url": rnd.choice(["/Home", "/product/1", "/cart", "/checkout", "/thank-you"])})
            aid += 1
    return tables(spark, orders, items, campaigns=[CAMP], sessions=sessions, activities=acts), \
        orders, items, sessions, acts


def test_new_buyers_with_a_hot_customer(skewed):
    t, orders, *_ = skewed
    first = {}
    for o in orders:
        first[o["customer_id"]] = min(first.get(o["customer_id"], o["order_date"]), o["order_date"])
    per_day = defaultdict(set)
    camp_day = defaultdict(bool)
    for o in orders:
        if o["order_date"] == first[o["customer_id"]]:
            per_day[o["order_date"]].add(o["customer_id"])
            camp_day[o["order_date"]] |= o["campaign_id"] is not None
    expect = defaultdict(int)
    for d, cs in per_day.items():
        expect["Campaign" if camp_day[d] else "Non-campaign"] += len(cs)
    got = {r["period_type"]: r["total_new_buyers"] for r in U.new_buyers_by_day_type(t).collect()}
    assert got == dict(expect)


def test_session_side_gmv_with_a_hot_order_and_null_keys(skewed):
    t, orders, items, sessions, _ = skewed
    order_gmv = defaultdict(lambda: M(0))
    for i in items:
        order_gmv[i["order_id"]] += i["line_total"]
    camp = [s for s in sessions if s["campaign_id"]]
    gmv = sum((order_gmv[int(s["order_id"])] for s in camp if s["order_id"]), M(0))
    r = C.campaign_cvr_and_lift(t).first()
    assert r["total_gmv"] == float(round(gmv))
    assert r["total_sessions"] == len(camp)
    assert r["converted_sessions"] == sum(1 for s in camp if s["order_id"])


def test_funnel_and_duration_with_a_bot_session(skewed, monkeypatch):
    monkeypatch.setattr(percentile, "MAP_MAX_KEYS", 0)          # exercise the radix rounds
    t, _, _, sessions, acts = skewed
    flags = defaultdict(set)
    for a in acts:
        flags[a["session_id"]].add(a["page_url"].lower())
    n_home = sum(1 for s in sessions if s["campaign_id"] and any("home" in u for u in flags[s["session_id"]]))
    n_prod = sum(1 for s in sessions if s["campaign_id"] and any("product" in u for u in flags[s["session_id"]]))
    f = {r["session_type"]: r for r in S.funnel_dropoff(t).collect()}
    assert f["Campaign"]["home_to_product_pct"] == round(100 * n_prod / n_home + 1e-9, 1)
    mins = sorted((s["session_end_time"] - s["session_start_time"]).total_seconds() / 60
                  for s in sessions if s["campaign_id"])
    pos = (len(mins) - 1) * 0.25
    lo = int(pos)
    q1 = mins[lo] + (pos - lo) * (mins[min(lo + 1, len(mins) - 1)] - mins[lo])
    d = {r["session_type"]: r for r in S.session_duration(t).collect()}
    assert d["Campaign"]["p25_minutes"] == pytest.approx(q1, abs=1e-6)
