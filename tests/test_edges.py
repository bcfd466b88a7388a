"""Hand-made rows for the edge cases and traps of the source semantics."""

import pytest

from builders import D, M, TS, day_of_items, item, tables
from promolens.operators import campaigns as C
from promolens.operators import customers as U
from promolens.operators import daily as DY
from promolens.operators import marts as MT
from promolens.operators import quality as Q
from promolens.operators import sessions as S

CAMP = {"campaign_id": "C1", "campaign_name": "Spring Sale", "campaign_type": "discount",
        "start_date": D("2024-04-13"), "end_date": D("2024-04-15")}


def baseline_days(n_items_per_day, start_order=100):
    orders, items = [], []
    for i, n in enumerate(n_items_per_day):
        o, its = day_of_items(start_order + i, f"2024-01-{i + 1:02d}", n)
        orders.append(o)
        items += its
    return orders, items


def test_threshold_is_inclusive(spark):
    orders, items = baseline_days([17, 18])
    t = tables(spark, orders, items)
    r = DY.fact_daily_baseline(t).first()
    assert r["days_used"] == 1 and r["median_daily_gmv"] == 1800.0
    assert DY.threshold_diagnostics(t).first()["total_days"] == 2


def test_no_baseline_day_gives_null_lift_but_keeps_rows(spark):
    orders, items = baseline_days([5])
    o, its = day_of_items(1, "2024-04-13", 2, campaign="C1")
    t = tables(spark, orders + [o], items + its, campaigns=[CAMP])
    assert DY.fact_daily_baseline(t).first()["median_daily_gmv"] is None
    rows = C.lift_by_campaign(t).collect()
    assert len(rows) == 1 and rows[0]["gmv_lift"] is None


def test_lift_divides_by_calendar_days(spark):
    orders, items = baseline_days([20, 20, 20])          # median day = 2000
    o, its = day_of_items(1, "2024-04-14", 30, campaign="C1")   # 3000 on one of three days
    t = tables(spark, orders + [o], items + its, campaigns=[CAMP])
    assert C.lift_by_campaign(t).first()["gmv_lift"] == 0.5


def test_zero_gmv_campaign_has_null_leakage(spark):
    o = {"order_id": 1, "order_date": D("2024-04-13"), "customer_id": "U1", "campaign_id": "C1"}
    t = tables(spark, [o], [item(1, 0, "Cancelled")], campaigns=[CAMP])
    assert C.campaign_leakage_detail(t).first()["leakage_pct"] is None


def test_null_status_leaks_in_one_form_only(spark):
    """Trap T5: total - Completed counts a NULL status; IN (Cancelled, Refunded) does not."""
    o = {"order_id": 1, "order_date": D("2024-04-13"), "customer_id": "U1", "campaign_id": "C1"}
    t = tables(spark, [o], [item(1, 100, None), item(1, 50, "Refunded"), item(1, 30)], campaigns=[CAMP])
    assert C.campaign_gmv_totals(t).first()["total_leaked_gmv"] == 150.0
    assert C.campaign_leakage_detail(t).first()["leaked_gmv"] == 50.0


def test_lag_uses_previous_available_year(spark):
    camps, orders, items = [], [], []
    for i, y in enumerate([2022, 2024, 2025]):          # 2023 missing
        cid = f"C{y}"
        camps.append({"campaign_id": cid, "campaign_name": "9.9 Sale", "campaign_type": "bundle",
                      "start_date": D(f"{y}-09-09"), "end_date": D(f"{y}-09-09")})
        o, its = day_of_items(i + 1, f"{y}-09-09", 1, amount=100 * (i + 1), campaign=cid)
        orders.append(o)
        items += its
    t = tables(spark, orders, items, campaigns=camps)
    r = {x["campaign_year"]: x for x in MT.fact_campaign_performance(t).collect()}
    assert r[2022]["prev_year_gmv"] is None and r[2022]["yoy_gmv_growth_pct"] is None
    assert r[2024]["prev_year_gmv"] == 100.0 and r[2024]["yoy_gmv_growth_pct"] == 100.0
    assert r[2025]["yoy_gmv_growth_pct"] == 50.0


def test_new_buyer_day_counted_once_in_report_and_twice_in_mart(spark):
    """Trap T1: one customer with a campaign and a non-campaign first-day order."""
    orders = [{"order_id": 1, "order_date": D("2024-04-13"), "customer_id": "U1", "campaign_id": "C1"},
              {"order_id": 2, "order_date": D("2024-04-13"), "customer_id": "U1", "campaign_id": None},
              {"order_id": 3, "order_date": D("2024-04-20"), "customer_id": "U1", "campaign_id": None}]
    t = tables(spark, orders, campaigns=[CAMP])
    rf = {r["period_type"]: r["total_new_buyers"] for r in U.new_buyers_by_day_type(t).collect()}
    sc = {r["period_type"]: r["total_new_buyers"] for r in U.fact_new_buyers(t).collect()}
    assert rf == {"Campaign": 1}
    assert sc == {"Campaign": 1, "Non-campaign": 1}


def test_shared_order_counts_twice_from_sessions(spark):
    """Trap T6: two sessions reaching one order both bring its GMV."""
    o = {"order_id": 7, "order_date": D("2024-04-13"), "customer_id": "U1", "campaign_id": "C1"}
    sess = [{"session_id": s, "user_id": "U1", "session_date": D("2024-04-13"),
             "session_start_time": TS("2024-04-13 10:00:00"), "campaign_id": "C1", "order_id": "7"}
            for s in ("S1", "S2")]
    sess.append({"session_id": "S3", "user_id": "U2", "session_date": D("2024-04-13"),
                 "session_start_time": TS("2024-04-13 10:00:00"), "campaign_id": "C1", "order_id": "x9"})
    sess.append({"session_id": "S4", "user_id": "U3", "session_date": D("2024-04-13"),
                 "session_start_time": TS("2024-04-13 10:00:00"), "campaign_id": "C1", "order_id": None})
    t = tables(spark, [o], [item(7, 100), item(7, 50)], campaigns=[CAMP], sessions=sess)
    r = C.campaign_cvr_and_lift(t).first()
    assert r["total_gmv"] == 300.0
    assert r["total_sessions"] == 4 and r["converted_sessions"] == 3   # non-numeric text still converted
    assert r["cvr_pct"] == 75.0


def _session(sid, start, end, campaign=None, order=None):
    return {"session_id": sid, "user_id": "U" + sid, "session_date": D("2024-01-01"),
            "session_start_time": TS(start), "session_end_time": TS(end) if end else None,
            "campaign_id": campaign, "order_id": order}


def test_session_duration_populations_differ(spark):
    """Trap T14: M18 keeps end > start; M23 keeps all sessions with activity, skipping NULL."""
    sess = [_session("1", "2024-01-01 10:00:00", "2024-01-01 10:10:00"),
            _session("2", "2024-01-01 10:00:00", "2024-01-01 10:00:00"),
            _session("3", "2024-01-01 10:00:00", "2024-01-01 09:58:00"),
            _session("4", "2024-01-01 10:00:00", None)]
    acts = [{"activity_id": i, "session_id": s, "page_url": "/Home"} for i, s in enumerate("1234")]
    t = tables(spark, sessions=sess, activities=acts)
    m18 = S.session_duration(t).first()
    assert m18["sessions"] == 1 and m18["mean_minutes"] == 10.0
    m23 = S.fact_funnel(t).first()
    assert m23["total_sessions"] == 4
    assert m23["mean_session_minutes"] == pytest.approx(round((10 + 0 - 2) / 3, 1))
    assert m23["median_session_minutes"] == 0.0


def test_funnel_flags_are_independent(spark):
    """Trap T13: '/product/cart-cover' sets two flags; cart without product passes 100%."""
    sess = [_session(s, "2024-01-01 10:00:00", "2024-01-01 10:05:00") for s in ("a", "b", "c")]
    acts = [{"activity_id": 1, "session_id": "a", "page_url": "/HOME"},
            {"activity_id": 2, "session_id": "a", "page_url": "/product/cart-cover"},
            {"activity_id": 3, "session_id": "b", "page_url": "/Cart"}]
    t = tables(spark, sessions=sess, activities=acts)
    r = S.funnel_dropoff(t).first()
    assert r["sessions"] == 2                       # session c has no activity
    assert r["home_to_product_pct"] == 100.0 and r["product_to_cart_pct"] == 200.0
    assert S.overall_cvr(t).first()["total_sessions"] == 3


def test_campaign_without_enrolment_keeps_row(spark):
    c2 = dict(CAMP, campaign_id="C2")
    prods = [{"product_id": "P1", "seller_id": "S1", "category": "Home"}]
    enrol = [{"product_campaign_id": "e1", "product_id": "P1", "campaign_id": "C1",
              "discount_percent": M("12.50")},
             {"product_campaign_id": "e2", "product_id": "P9", "campaign_id": "C1",
              "discount_percent": M("20.00")}]
    t = tables(spark, campaigns=[CAMP, c2], products=prods, enrol=enrol)
    r = {x["campaign_id"]: x for x in MT.dim_campaign(t).collect()}
    assert r["C2"]["total_products_enrolled"] == 0 and r["C2"]["avg_seller_discount_offered_pct"] is None
    assert r["C1"]["total_products_enrolled"] == 2 and r["C1"]["total_sellers_enrolled"] == 1
    assert r["C1"]["avg_seller_discount_offered_pct"] == 16.25
    assert r["C1"]["duration_days"] == 3


def test_mean_of_rounded_lifts_rounds_ties_up(spark):
    """Trap T3 plus exact rounding: mean of 1.23 and 1.24 is 1.235 -> 1.24."""
    camps, orders, items = [], [], []
    base_orders, base_items = baseline_days([20])                     # baseline 2000 / day
    for i, amt in enumerate([2460, 2480]):                            # lifts 1.23 and 1.24
        cid = f"K{i}"
        camps.append({"campaign_id": cid, "campaign_name": "9.9 Sale", "campaign_type": "bundle",
                      "start_date": D(f"202{i}-09-09"), "end_date": D(f"202{i}-09-09")})
        o, its = day_of_items(i + 1, f"202{i}-09-09", 1, amount=amt, campaign=cid)
        orders.append(o)
        items += its
    t = tables(spark, base_orders + orders, base_items + items, campaigns=camps)
    r = C.lift_by_campaign_type(t).first()
    assert (r["min_lift"], r["max_lift"], r["mean_lift"], r["median_lift"]) == (1.23, 1.24, 1.24, 1.235)


def test_distinct_on_keeps_first_by_order(spark):
    orders = [{"order_id": 5, "order_date": D("2024-01-02"), "customer_id": "U1"},
              {"order_id": 9, "order_date": D("2024-01-01"), "customer_id": "U1"},
              {"order_id": 3, "order_date": D("2024-01-01"), "customer_id": "U1"},
              {"order_id": 4, "order_date": D("2024-01-03"), "customer_id": "U2"}]
    t = tables(spark, orders)
    r = {x["customer_id"]: x["order_id"] for x in Q.first_order_per_customer(t).collect()}
    assert r == {"U1": 3, "U2": 4}


def test_quality_checks_find_duplicates_orphans_and_nulls(spark):
    orders = [{"order_id": 1, "order_date": D("2024-01-01"), "customer_id": "U1", "campaign_id": "CX"}]
    items = [item(1, 10, n=1), item(1, 10, n=1), item(2, 10, "Lost", n=2)]
    t = tables(spark, orders, items)
    pk = {r["table_name"]: r for r in Q.pk_uniqueness(t).collect()}
    assert pk["raw_order_items"]["n_rows"] == 3 and pk["raw_order_items"]["n_distinct"] == 2
    fk = {r["relation"]: r["n_orphans"] for r in Q.fk_orphans(t).collect()}
    assert fk["order_items.order_id -> orders"] == 1 and fk["orders.campaign_id -> campaigns"] == 1
    dom = {r["item_status"]: r["in_domain"] for r in Q.status_domain(t).collect()}
    assert dom == {"Completed": True, "Lost": False}


def test_load_clean_parses_midnight_suffix(spark):
    df = spark.createDataFrame([(1, "2023-05-06 00:00:00", "Saturday", "2023-05")],
                               "order_id long, order_date string, order_day string, year_month string")
    out = Q.load_clean(df)
    assert out.columns == ["order_id", "order_date"] and out.first()["order_date"] == D("2023-05-06")


def test_descending_report_order_puts_nulls_first(spark):
    """Trap T9: PostgreSQL sorts NULL first in DESC (Spark's default is last)."""
    camps, orders, items = [], [], []
    base_orders, base_items = baseline_days([20])
    for i, (ctype, amt) in enumerate([("bundle", 4000), ("voucher", 2000)]):
        cid = f"T{i}"
        camps.append({"campaign_id": cid, "campaign_name": "9.9 Sale", "campaign_type": ctype,
                      "start_date": D(f"202{i}-09-09"), "end_date": D(f"202{i}-09-09")})
        o, its = day_of_items(i + 1, f"202{i}-09-09", 1, amount=amt, campaign=cid)
        orders.append(o)
        items += its
    t = tables(spark, base_orders + orders, base_items + items, campaigns=camps)
    assert [r["median_lift"] for r in C.lift_by_campaign_type(t).collect()] == [2.0, 1.0]
    t0 = tables(spark, orders, items, campaigns=camps)            # no baseline day: NULL lifts
    rows = C.lift_by_campaign(t0).collect()
    assert [r["campaign_type"] for r in rows] == ["bundle", "voucher"]
    assert all(r["gmv_lift"] is None for r in rows)


def test_order_helpers_follow_postgres(spark):
    from promolens.functions.order import asc, desc
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    assert [r["x"] for r in df.orderBy(desc("x")).collect()] == [None, 2.0, 1.0]
    assert [r["x"] for r in df.orderBy(asc("x")).collect()] == [1.0, 2.0, None]
