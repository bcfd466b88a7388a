"""Category metrics of campaign orders: order values, shares, item values.

All of them read one stored table of campaign items by category, order and value (:func:`shelf`); item-level
medians use the exact distributed percentiles (groups grow with the data); shares of a grand total are windows over the already aggregated
one-row-per-category result.

Keys: M14 category_order_value, M15 category_share,
M22 fact_category_performance, N04 category_concentration,
N10 category_discount_return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import desc
from ..functions.exprs import (avg_exact, cents, completed_amount, dbl, exact_div,
                               leaked_in_amount, median_out, pct)
from ..functions.percentile import counted_percentiles, large_percentiles
from ..plans.grains import add_up, per_identifier
from ..plans.joins import bounded_broadcast, join_null_safe
from ..plans.materialize import materialize
from ..sources.tables import Tables
from .campaigns import campaign_year

TOP_CATEGORIES = 2


def _from_cents(c: F.Column) -> F.Column:
    return c.cast("double") / 100.0


def _campaign_items_with_category(t: Tables) -> DataFrame:
    p = t.products_small("product_id", "category")
    return t.item_orders(campaign=True).join(p, "product_id")


_SUMS = ["n_items", "gmv", "realized", "leaked", "comm", "comm_n", "disc", "disc_n"]


def shelf(t: Tables) -> DataFrame:
    """Campaign items by (campaign_id, category, order_id, cents): ``lines`` and their sums, stored.

    The one scan of the campaign items for the category metrics: item medians take ``cents`` with ``lines`` as its
    count, orders are counted on (category, order) rows, and every total is a sum of its sums.
    """
    def build() -> DataFrame:
        return materialize(per_identifier(_campaign_items_with_category(t), ["campaign_id", "category"], ["order_id", cents("line_total").alias("cents")], [
            F.count(F.lit(1)).alias("lines"),
            F.count("order_item_id").alias("n_items"),
            F.sum("line_total").alias("gmv"),
            F.sum(completed_amount()).alias("realized"),
            F.sum(leaked_in_amount()).alias("leaked"),
            F.sum("commission_amount").alias("comm"),
            F.count("commission_amount").alias("comm_n"),
            F.sum("discount_percent").alias("disc"),
            F.count("discount_percent").alias("disc_n")]), "shelf")
    return t.shared("shelf", build)


def _per_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of shelf rows per ``keys`` with the number of distinct orders (two levels, no Expand)."""
    per_order = per_identifier(rows, keys, ["order_id"], add_up(rows, _SUMS))
    return per_order.groupBy(*keys).agg(F.count("order_id").alias("total_orders"), *add_up(per_order, _SUMS))


def category_order_value(t: Tables) -> DataFrame:
    """Value of campaign orders per category (order x category sums).

    The source joins products back on category, so each order value repeats
    once per product of its category. Mean, max and distinct counts do not
    change; the percentiles do, and are computed here with the product count
    of the category as the frequency of each value instead of the fan-out.
    """
    rows = shelf(t).where(F.col("category").isNotNull())
    ov = rows.groupBy("order_id", "category").agg(*add_up(rows, ["gmv"]))
    n_products = (t.products.where(F.col("category").isNotNull())
                  .groupBy("category").agg(F.count(F.lit(1)).alias("n_products")))
    # One stored (category, value, counts) table gives the counts, the mean, the maximum and the percentiles.
    values = (ov.groupBy("category", cents("gmv").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count("order_id").alias("n_orders"))
              .join(bounded_broadcast(n_products), "category")       # one row per category
              .withColumn("times", F.col("n") * F.col("n_products")))
    values = materialize(values, "order-values")
    money = lambda c: (c.cast("decimal(30,0)") * F.lit("0.01").cast("decimal(3,2)"))
    base = values.groupBy("category").agg(
        F.sum("n_orders").alias("total_orders"),
        exact_div(money(F.sum(F.col("k").cast("decimal(20,0)") * F.col("n").cast("decimal(10,0)"))),
                  F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), 2, 0).alias("mean"),
        money(F.max("k")).alias("mx"))
    q = counted_percentiles(values, ["category"], "k", "times", {"median": 0.5, "p90": 0.9}, _from_cents)
    j = join_null_safe(base, q, ["category"], "left")
    return j.select("category", "total_orders",
                    dbl("mean", 0).alias("mean_order_value"),
                    median_out("median").alias("median_order_value"),
                    median_out("p90").alias("p90_order_value"),
                    dbl("mx", 0).alias("max_order_value")).orderBy(desc("median_order_value"))


def _category_totals(t: Tables) -> DataFrame:
    """Campaign orders per category: orders, GMV, realized GMV, mean commission (stored once)."""
    return t.shared("category_totals", lambda: materialize(
        _per_group(shelf(t), ["category"]).withColumn("comm", exact_div("comm", "comm_n", 2, 0)), "category-totals"))


def category_share(t: Tables) -> DataFrame:
    """Order, GMV and realized-GMV shares per category; median item value.

    The realized share divides by the total GMV of all categories.
    """
    everything = Window.partitionBy()      # one row per category: bounded
    g = (_category_totals(t)
         .withColumn("all_orders", F.sum("total_orders").over(everything))
         .withColumn("all_gmv", F.sum("gmv").over(everything)))
    med = counted_percentiles(shelf(t), ["category"], "cents", "lines", {"median_item_value": 0.5}, _from_cents)
    j = join_null_safe(g, med, ["category"], "left")
    return j.select(
        "category", "total_orders",
        pct("total_orders", "all_orders", 1).alias("orders_pct"),
        dbl("gmv", 0).alias("total_gmv"),
        pct("gmv", "all_gmv", 1, 2, 2).alias("gmv_pct"),
        pct("realized", "all_gmv", 1, 2, 2).alias("realized_gmv_pct"),
        median_out("median_item_value").alias("median_item_value"),
        dbl("comm", 2).alias("commission_per_item")).orderBy(desc("total_gmv"))


def category_concentration(t: Tables, top_n: int = TOP_CATEGORIES) -> DataFrame:
    """Combined GMV and order share of the top categories by GMV (ties by name)."""
    rank = F.row_number().over(Window.orderBy(F.col("gmv").desc(), F.col("category").asc_nulls_last()))
    g = _category_totals(t).withColumn("rn", rank)     # one row per category: bounded
    top = F.col("rn") <= top_n
    a = g.agg(F.sum(F.when(top, F.col("gmv"))).alias("tg"), F.sum("gmv").alias("ag"),
              F.sum(F.when(top, F.col("total_orders"))).alias("to"),
              F.sum("total_orders").alias("ao"))
    return a.select(pct("tg", "ag", 1, 2, 2).alias("gmv_pct"), pct("to", "ao", 1).alias("orders_pct"))


def category_discount_return(t: Tables) -> DataFrame:
    """Mean offered discount per category (enrolments) beside its campaign GMV share."""
    p = t.products.select("product_id", "category")
    d = (t.product_campaign.join(p, "product_id")
         .groupBy("category").agg(avg_exact("discount_percent", 2).alias("disc")))
    everything = Window.partitionBy()      # one row per category: bounded
    share = (_category_totals(t).withColumn("all_gmv", F.sum("gmv").over(everything))
             .select("category", pct("gmv", "all_gmv", 1, 2, 2).alias("gmv_pct")))
    return (join_null_safe(d, share, ["category"], "left")
             .select("category", dbl("disc", 2).alias("avg_offered_discount_pct"), "gmv_pct"))


def fact_category_performance(t: Tables) -> DataFrame:
    """Campaign x category mart with shares within the campaign."""
    x = shelf(t).join(t.campaigns_small().select("campaign_id", "start_date"), "campaign_id")
    g = (_per_group(x, ["campaign_id", "category", "start_date"]).withColumn("disc", exact_div("disc", "disc_n", 2, 0))
         .withColumnRenamed("n_items", "total_items"))
    in_campaign = Window.partitionBy("campaign_id")   # categories of one campaign: bounded
    g = (g.withColumn("c_gmv", F.sum("gmv").over(in_campaign))
          .withColumn("c_orders", F.sum("total_orders").over(in_campaign)))
    med = large_percentiles(x, ["campaign_id", "category"], "cents", {"median_item_value": 0.5}, _from_cents, weight="lines")
    j = join_null_safe(g, med, ["campaign_id", "category"], "left")
    return j.select(
        "campaign_id", "category", campaign_year().alias("campaign_year"),
        "total_items", "total_orders",
        dbl("gmv", 0).alias("total_gmv"),
        dbl("realized", 0).alias("realized_gmv"),
        dbl("leaked", 0).alias("leaked_gmv"),
        pct("leaked", "gmv", 2, 2, 2).alias("leakage_pct"),
        dbl("disc", 2).alias("avg_discount_pct"),
        median_out("median_item_value").alias("median_item_value"),
        dbl(exact_div("comm", "total_items", 2, 0), 2).alias("commission_per_item"),
        pct("gmv", "c_gmv", 1, 2, 2).alias("gmv_pct_within_campaign"),
        pct("total_orders", "c_orders", 1).alias("orders_pct_within_campaign"))
