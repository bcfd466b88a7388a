"""The dimension and fact tables, the monthly trend, and the mart writer.

Keys: M08 monthly_gmv_trend, M19 dim_campaign, M20 dim_category,
M21 fact_campaign_performance, M25 fact_monthly_gmv. The remaining marts live
with their subject: M22 in categories, M23 in sessions, M24 in customers,
M26 in daily. :func:`build_marts` returns all eight by table name and
:func:`write_marts` stores them (the ``CREATE TABLE ... AS SELECT`` step).
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import asc
from ..functions.exprs import (MIN_DAILY_ITEMS, completed_amount, dbl, exact_div,
                               inclusive_days, item_cents, pct)
from ..sources.tables import Tables
from ..plans.grains import add_up, day_mask, days_in, per_identifier
from ..plans.materialize import materialize
from ..plans.publish import publish
from .campaigns import (ATTRIBUTION_COLS, CAMPAIGN_COLS, attribution_counts, campaign_cvr, campaign_summary, campaign_year,
                        revenue_expr)
from .categories import fact_category_performance
from .customers import fact_new_buyers
from .daily import baseline_median_gmv, fact_daily_baseline
from .sessions import fact_funnel


def dim_campaign(t: Tables) -> DataFrame:
    """Campaigns with calendar attributes and enrolment counts.

    Enrolments are aggregated per campaign before the (left) join, so a
    campaign with a third of all enrolments is still a partial aggregate; a
    campaign without enrolments keeps its row with 0 counts and a NULL mean.
    They are shuffled once, to their product: there one row of each (product,
    campaign) is marked, and marks, sellers and discounts add up to one row per
    (campaign, seller). So no task holds a table of the enrolments it reads.
    """
    p = t.products.select("product_id", "seller_id").hint("merge")
    nth = F.row_number().over(Window.partitionBy("product_id", "campaign_id").orderBy(F.lit(0)))
    rows = (t.product_campaign.select("campaign_id", "product_id", "discount_percent")
            .join(p, "product_id", "left").withColumn("is_product", (F.col("product_id").isNotNull() & (nth == 1)).cast("long")))
    per_seller = rows.groupBy("campaign_id", "seller_id").agg(
        F.sum("is_product").alias("products"), F.sum(F.col("discount_percent").cast("decimal(22,2)")).alias("disc_sum"),
        F.count("discount_percent").alias("disc_n"))
    enrol = per_seller.groupBy("campaign_id").agg(
        F.sum("products").alias("n_products"), F.count("seller_id").alias("n_sellers"),
        exact_div(F.sum("disc_sum"), F.sum("disc_n"), 2, 0).alias("disc"))
    c = t.campaigns.select(*CAMPAIGN_COLS)
    j = c.join(enrol, "campaign_id", "left")
    return j.select(
        "campaign_id", "campaign_name", "campaign_type", "start_date", "end_date",
        campaign_year().alias("campaign_year"),
        F.month("start_date").cast("long").alias("campaign_month"),
        inclusive_days().cast("long").alias("duration_days"),
        F.coalesce("n_products", F.lit(0)).cast("long").alias("total_products_enrolled"),
        F.coalesce("n_sellers", F.lit(0)).cast("long").alias("total_sellers_enrolled"),
        dbl("disc", 2).alias("avg_seller_discount_offered_pct"))


def dim_category(t: Tables) -> DataFrame:
    """Distinct product categories."""
    return t.products.select("category").distinct()


def fact_campaign_performance(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """The main mart, one row per campaign, with YoY by event name.

    LAG runs over the rounded totals and by name only, so a type change or a
    missing year is not seen (the previous available year is used). Within a
    name and year, campaign_id orders the rows (the source leaves it open).
    """
    base = baseline_median_gmv(t, min_daily_items)
    ca = campaign_summary(t).withColumn("disc", exact_div("disc_sum", "disc_n", 2, 0))
    days = inclusive_days()
    ca = ca.select(
        "campaign_id", "campaign_name", campaign_year().alias("campaign_year"),
        "total_orders", "unique_buyers",
        F.round("gmv", 0).alias("total_gmv_d"),
        dbl("realized", 0).alias("realized_gmv"),
        dbl("leaked", 0).alias("leaked_gmv"),
        dbl(F.col("comm") + F.col("maint"), 0).alias("platform_revenue"),
        dbl(exact_div("gmv", days, 2, 0), 0).alias("gmv_per_day"),
        F.round(F.col("gmv") / days / base.scalar(), 2).alias("corrected_lift"),
        pct("leaked", "gmv", 2, 2, 2).alias("leakage_pct"),
        dbl("disc", 2).alias("avg_discount_pct"))
    j = ca.join(campaign_cvr(t), "campaign_id", "left")
    # One row per campaign: the window per event name is bounded by the years.
    # Two campaigns of one name in one year would leave the order undefined;
    # campaign_id breaks that tie so the result is deterministic.
    w = Window.partitionBy("campaign_name").orderBy("campaign_year", "campaign_id")
    prev_gmv = F.lag("total_gmv_d").over(w)
    prev_orders = F.lag("total_orders").over(w)
    return j.select(
        "campaign_id", "campaign_name", "campaign_year", "total_orders", "unique_buyers",
        dbl("total_gmv_d").alias("total_gmv"), "realized_gmv", "leaked_gmv", "platform_revenue",
        "gmv_per_day", "corrected_lift", "leakage_pct", "avg_discount_pct", "cvr_pct", "total_sessions",
        dbl(prev_gmv).alias("prev_year_gmv"),
        pct(F.col("total_gmv_d") - prev_gmv, prev_gmv, 1).alias("yoy_gmv_growth_pct"),
        pct(F.col("total_orders") - prev_orders, prev_orders, 1).alias("yoy_orders_growth_pct"))


def monthly_summary(t: Tables) -> DataFrame:
    """One row per calendar month of all orders: orders, active days, GMV, realized, revenue,
    and the item counts of the attribution audit.

    A full scan of the item fact, so it is built once per table bundle and
    stored; the monthly trend, the monthly mart, the yearly platform revenue
    and the attribution audit (additive rollups of the months) read it.

    Two levels: items add up to one row per (month, order), and the orders of a
    month are counted there; active days travel as a bit mask of the days of
    the month. No distinct aggregate, so no Expand over the item fact. The many
    rows of the first level are narrow: the month is one date, an order's amounts are
    cents (a long holds 92,000 items of the largest amount), and months add them up as decimals.
    """
    def build() -> DataFrame:
        *traced, total = ATTRIBUTION_COLS                # a flagged item is counted in one of the first three
        per_order = per_identifier(t.item_orders(), [F.trunc("order_date", "month").alias("month")], ["order_id"], [
            F.sum(item_cents("line_total")).alias("gmv"),
            F.sum(completed_amount(item_cents("line_total"))).alias("realized"),
            F.sum(item_cents(revenue_expr())).alias("rev"),
            day_mask("order_date").alias("days"),
            *attribution_counts()[:len(traced)]])

        def amount(c: str, digits: int) -> Column:
            return (F.sum(F.col(c).cast("decimal(22,0)")) * F.lit(Decimal("0.01"))).cast(f"decimal({digits},2)").alias(c)

        g = per_order.groupBy("month").agg(
            F.count("order_id").alias("total_orders"),
            days_in(F.bit_or("days")).alias("days_in_month"),
            amount("gmv", 24), amount("realized", 24), amount("rev", 23), *add_up(per_order, traced))
        return materialize(g.select(
            F.year("month").cast("long").alias("order_year"), F.month("month").cast("long").alias("order_month"), *g.columns[1:],
            sum(map(F.col, traced[1:]), F.col(traced[0])).alias(total)), "monthly-summary")
    return t.shared("monthly_summary", build)


def monthly_gmv_trend(t: Tables) -> DataFrame:
    """Orders, GMV and GMV per active day, per month."""
    m = monthly_summary(t)
    return m.select("order_year", "order_month", "total_orders",
                    dbl("gmv", 0).alias("total_gmv"),
                    dbl(exact_div("gmv", "days_in_month", 2, 0), 0).alias("avg_daily_gmv")
                    ).orderBy(asc("order_year"), asc("order_month"))


def fact_monthly_gmv(t: Tables) -> DataFrame:
    """M08 plus realized GMV and the number of active days."""
    m = monthly_summary(t)
    return m.select("order_year", "order_month", "total_orders",
                    dbl("gmv", 0).alias("total_gmv"),
                    dbl("realized", 0).alias("realized_gmv"),
                    "days_in_month",
                    dbl(exact_div("gmv", "days_in_month", 2, 0), 0).alias("avg_daily_gmv"))


MART_BUILDERS = {
    "dim_campaign": dim_campaign,
    "dim_category": dim_category,
    "fact_campaign_performance": fact_campaign_performance,
    "fact_category_performance": fact_category_performance,
    "fact_funnel": fact_funnel,
    "fact_new_buyers": fact_new_buyers,
    "fact_monthly_gmv": fact_monthly_gmv,
    "fact_daily_baseline": fact_daily_baseline,
}


def build_marts(t: Tables) -> dict[str, DataFrame]:
    return {name: fn(t) for name, fn in MART_BUILDERS.items()}


def write_marts(t: Tables, out_dir: str, mode: str = "overwrite") -> dict[str, str]:
    """Write the eight derived tables as Parquet under ``out_dir`` (one folder each), all or none of them."""
    def writer(df: DataFrame):
        return lambda path: df.write.parquet(path)
    return publish(t.spark, out_dir, {name: writer(df) for name, df in build_marts(t).items()}, mode=mode)


def save_marts(t: Tables, database: str | None = None, mode: str = "overwrite") -> list[str]:
    """``CREATE TABLE ... AS SELECT`` for the eight derived tables, as catalog tables."""
    from ..sources.raw import use_schema

    spark = t.spark
    if database:
        use_schema(spark, database, create=True)
    made = uuid.uuid4().hex[:12]
    try:
        for name, df in build_marts(t).items():                  # a failure here leaves the tables as they were
            if mode != "overwrite" and spark.catalog.tableExists(name):
                raise FileExistsError(name)
            df.write.saveAsTable(f"{name}_{made}")
        for name in MART_BUILDERS:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            spark.sql(f"ALTER TABLE `{name}_{made}` RENAME TO `{name}`")
    except BaseException:
        for name in MART_BUILDERS:
            spark.sql(f"DROP TABLE IF EXISTS `{name}_{made}`")
        raise
    return list(MART_BUILDERS)
