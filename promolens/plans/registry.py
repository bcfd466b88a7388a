"""Registry of the user-level operators: query key -> DataFrame builder.

Every builder takes the raw tables (:class:`~promolens.sources.tables.Tables`)
and returns a lazy DataFrame; nothing runs until an action. ``run`` binds a
builder to the driver's test tables under ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import campaigns as C
from ..operators import categories as K
from ..operators import customers as U
from ..operators import daily as D
from ..operators import marts as M
from ..operators import quality as Q
from ..operators import sessions as S
from ..session import session_key
from ..sources import fixture
from ..sources.tables import Tables

Builder = Callable[[Tables], DataFrame]

# Report queries (M01-M18), derived tables (M19-M26), report-only metrics
# (N01-N14), preparation and quality jobs (Q01-Q10).
REGISTRY: dict[str, Builder] = {
    "threshold_diagnostics": D.threshold_diagnostics,          # M01
    "gmv_baseline_distribution": D.gmv_baseline_distribution,  # M02
    "leakage_baseline": D.leakage_baseline,                    # M03
    "attribution_audit": C.attribution_audit,                  # M04
    "lift_by_campaign_type": C.lift_by_campaign_type,          # M05
    "lift_by_campaign": C.lift_by_campaign,                    # M06
    "campaign_cvr_and_lift": C.campaign_cvr_and_lift,          # M07
    "monthly_gmv_trend": M.monthly_gmv_trend,                  # M08
    "yearly_revenue_growth": C.yearly_revenue_growth,          # M09
    "new_buyers_by_day_type": U.new_buyers_by_day_type,        # M10
    "leakage_vs_baseline": C.leakage_vs_baseline,              # M11
    "campaign_gmv_totals": C.campaign_gmv_totals,              # M12
    "campaign_leakage_detail": C.campaign_leakage_detail,      # M13
    "category_order_value": K.category_order_value,            # M14
    "category_share": K.category_share,                        # M15
    "overall_cvr": S.overall_cvr,                              # M16
    "funnel_dropoff": S.funnel_dropoff,                        # M17
    "session_duration": S.session_duration,                    # M18
    "dim_campaign": M.dim_campaign,                            # M19
    "dim_category": M.dim_category,                            # M20
    "fact_campaign_performance": M.fact_campaign_performance,  # M21
    "fact_category_performance": K.fact_category_performance,  # M22
    "fact_funnel": S.fact_funnel,                              # M23
    "fact_new_buyers": U.fact_new_buyers,                      # M24
    "fact_monthly_gmv": M.fact_monthly_gmv,                    # M25
    "fact_daily_baseline": D.fact_daily_baseline,              # M26
    "baseline_skewness": D.baseline_skewness,                  # N01
    "typical_day_multiple": C.typical_day_multiple,            # N02
    "programme_growth": C.programme_growth,                    # N03
    "category_concentration": K.category_concentration,        # N04
    "leakage_sensitivity": C.leakage_sensitivity,              # N05
    "take_rate": C.take_rate,                                  # N06
    "threshold_sensitivity": C.threshold_sensitivity,          # N07
    "attribution_share": C.attribution_share,                  # N08
    "leaked_gmv_by_year": C.leaked_gmv_by_year,                # N09
    "category_discount_return": K.category_discount_return,    # N10
    "funnel_stage_gap": S.funnel_stage_gap,                    # N11
    "realized_lift": C.realized_lift,                          # N12
    "below_baseline_campaigns": C.below_baseline_campaigns,    # N13
    "event_ranking": C.event_ranking,                          # N14
    "pk_uniqueness": Q.pk_uniqueness,                          # Q01
    "fk_orphans": Q.fk_orphans,                                # Q02
    "not_null_violations": Q.not_null_violations,              # Q03
    "null_profile": Q.null_profile,                            # Q04
    "table_profile": Q.table_profile,                          # Q05
    "distinct_profile": Q.distinct_profile,                    # Q06
    "name_type_drift": Q.name_type_drift,                      # Q07
    "distinct_on": Q.first_order_per_customer,                 # Q09
    "status_domain": Q.status_domain,                          # Q10
}

# Q08 reads the exported (text-dated) form of the orders, not the mapped tables.
SOURCE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_clean": lambda spark, sf_dir: Q.load_clean_orders(spark.read.parquet(f"{sf_dir}/orders.parquet")),
}

_TABLES: dict[tuple[str, int, str], Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """The raw tables for the driver tables under ``sf_dir``, one bundle per session.

    Each table is mapped and stored under the checkpoint folder when a query first
    reads it; later queries of the session read the stored table, as a production job would.
    """
    key = (session_key(spark), id(spark), sf_dir)
    if key not in _TABLES:
        _TABLES[key] = fixture.StoredTables(spark, sf_dir)
    return _TABLES[key]


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in SOURCE_QUERIES:
        return SOURCE_QUERIES[name](spark, sf_dir)
    return REGISTRY[name](tables_for(spark, sf_dir))


def query_names() -> list[str]:
    return [*REGISTRY, *SOURCE_QUERIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _n=name: run(spark, sf_dir, _n)) for name in query_names()}
