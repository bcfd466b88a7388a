"""Cross-metric invariants at sf0.01 (the survey's consistency checks)."""

import pytest

from conftest import SF01
from promolens.plans.registry import run


def rows(spark, name):
    return run(spark, SF01, name).collect()


def test_shares_sum_to_about_100(spark):
    r = rows(spark, "category_share")
    assert sum(x["gmv_pct"] for x in r) == pytest.approx(100, abs=0.5)
    assert sum(x["orders_pct"] for x in r) == pytest.approx(100, abs=0.5)


def test_realized_plus_leaked_is_total(spark):
    for x in rows(spark, "campaign_leakage_detail"):
        assert x["realized_gmv"] + x["leaked_gmv"] == pytest.approx(x["total_gmv"], abs=1.0)


def test_type_summary_bounds_campaign_lifts(spark):
    by_type = {x["campaign_type"]: x for x in rows(spark, "lift_by_campaign_type")}
    lifts = {}
    for x in rows(spark, "lift_by_campaign"):
        lifts.setdefault(x["campaign_type"], []).append(x["gmv_lift"])
    for t, ls in lifts.items():
        assert by_type[t]["min_lift"] == min(ls) and by_type[t]["max_lift"] == max(ls)
        assert by_type[t]["n_campaigns"] == len(ls)


def test_baseline_table_equals_report_queries(spark):
    m26 = rows(spark, "fact_daily_baseline")[0]
    m02 = rows(spark, "gmv_baseline_distribution")[0]
    m03 = rows(spark, "leakage_baseline")[0]
    assert m26["median_daily_gmv"] == m02["median_daily_gmv"]
    assert m26["mean_daily_gmv"] == m02["mean_daily_gmv"]
    assert m26["days_used"] == m02["days_used"]
    assert m26["median_leakage_rate_pct"] == m03["leakage_median"]
    assert m26["median_cancel_rate_pct"] == m03["cancel_median"]


def test_campaign_detail_sums_to_totals(spark):
    m12 = rows(spark, "campaign_gmv_totals")[0]
    m13 = rows(spark, "campaign_leakage_detail")
    assert sum(x["total_gmv"] for x in m13) == pytest.approx(m12["total_campaign_gmv"], abs=len(m13))


def test_cvr_covers_every_session(spark):
    m16 = rows(spark, "overall_cvr")
    n = rows(spark, "table_profile")
    sessions = {x["table_name"]: x["n_rows"] for x in n}["raw_website_sessions"]
    assert sum(x["total_sessions"] for x in m16) == sessions


def test_mapping_figures(spark):
    """FIXTURES section 4 at sf0.01."""
    n = {x["table_name"]: x["n_rows"] for x in rows(spark, "table_profile")}
    assert n == {"raw_orders": 15000, "raw_campaigns": 35, "raw_order_items": 60000, "raw_products": 2000,
                 "raw_product_campaign": 14000, "raw_website_sessions": 4006,
                 "raw_session_activities": 10000}
    a = rows(spark, "attribution_audit")[0]
    assert (a["fully_attributed"], a["partial"], a["unattributable"]) == (28, 92, 8470)
    m26 = rows(spark, "fact_daily_baseline")[0]
    assert m26["days_used"] == 1735 and m26["median_daily_gmv"] == 1405765.08
