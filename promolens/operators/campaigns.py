"""Campaign-side metrics: attribution, lift, conversion, revenue, leakage.

A campaign is attributed only through ``orders.campaign_id`` (the item flag
``is_campaign`` is read by the attribution audit alone). Campaigns are a
small dimension joined by broadcast behind a size check; the one-row
baseline enters as a scalar subquery (``DataFrame.scalar()``), not a join.

Keys: M04 attribution_audit, M05 lift_by_campaign_type, M06 lift_by_campaign,
M07 campaign_cvr_and_lift, M09 yearly_revenue_growth, M11 leakage_vs_baseline,
M12 campaign_gmv_totals, M13 campaign_leakage_detail, N02 typical_day_multiple,
N03 programme_growth, N05 leakage_sensitivity, N06 take_rate,
N07 threshold_sensitivity, N08 attribution_share, N09 leaked_gmv_by_year,
N12 realized_lift, N13 below_baseline_campaigns, N14 event_ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import asc, desc
from ..functions.exprs import (MIN_DAILY_ITEMS, avg_exact, completed_amount, dbl, exact_div,
                               inclusive_days, leaked_in_amount, median_out, pct)
from ..plans.bloom import might_match
from ..plans.grains import add_up, per_identifier
from ..plans.joins import join_null_safe
from ..plans.materialize import materialize
from ..sources.tables import Tables
from .daily import baseline_median_gmv, daily_non_campaign

CAMPAIGN_COLS = ("campaign_id", "campaign_name", "campaign_type", "start_date", "end_date")


def revenue_expr() -> F.Column:
    """Platform revenue of an item: commission plus maintenance."""
    return F.col("commission_amount") + F.col("maintenance_amount")


def campaign_items(t: Tables) -> DataFrame:
    """Items of campaign orders with their campaign's attributes (inner join)."""
    c = t.campaigns_small().select(*CAMPAIGN_COLS)
    return t.item_orders(campaign=True).join(c, "campaign_id")


_TOTALS = ["gmv", "realized", "leaked", "comm", "maint", "rev", "disc_sum", "disc_n"]


def campaign_orders(t: Tables) -> DataFrame:
    """One row per (campaign_id, order, customer) of campaign orders, with its item totals.

    The one scan of the campaign items: per-campaign totals, distinct orders,
    distinct buyers and the buyers of a year all come from this stored table.
    """
    def build() -> DataFrame:
        return materialize(per_identifier(t.item_orders(campaign=True), ["campaign_id"], ["order_id", "customer_id"], [
            F.sum("line_total").alias("gmv"),
            F.sum(completed_amount()).alias("realized"),
            F.sum(leaked_in_amount()).alias("leaked"),
            F.sum("commission_amount").alias("comm"),
            F.sum("maintenance_amount").alias("maint"),
            F.sum(revenue_expr()).alias("rev"),
            F.sum("discount_percent").alias("disc_sum"),
            F.count("discount_percent").alias("disc_n")]), "campaign-orders")
    return t.shared("campaign_orders", build)


def campaign_summary(t: Tables) -> DataFrame:
    """One row per campaign with the additive item totals and distinct counts.

    Built once per table bundle and stored (lift, leakage, the main mart,
    the yearly and per-event rollups all read it). Sums stay exact decimals.
    Orders and buyers are counted side by side as rows of one column each, so
    neither count expands the rows of the other.
    """
    def build() -> DataFrame:
        o = campaign_orders(t)
        orders = per_identifier(o, ["campaign_id"], ["order_id"], add_up(o, _TOTALS))
        orders = orders.withColumn("is_order", F.col("order_id").isNotNull().cast("long")).withColumn("is_buyer", F.lit(0).cast("long"))
        buyers = o.where(F.col("customer_id").isNotNull()).groupBy("campaign_id", "customer_id").agg(F.lit(1).cast("long").alias("is_buyer"))
        both = orders.drop("order_id").unionByName(buyers.drop("customer_id"), allowMissingColumns=True)
        per_id = both.groupBy("campaign_id").agg(
            F.coalesce(F.sum("is_order"), F.lit(0)).alias("total_orders"), F.sum("is_buyer").alias("unique_buyers"), *add_up(both, _TOTALS))
        g = per_id.join(t.campaigns_small().select(*CAMPAIGN_COLS), "campaign_id").groupBy(*CAMPAIGN_COLS).agg(
            *add_up(per_id, _TOTALS), F.max("total_orders").alias("total_orders"), F.max("unique_buyers").alias("unique_buyers"))
        return materialize(g, "campaign-summary")
    return t.shared("campaign_summary", build)


def campaign_year(col: str = "start_date") -> F.Column:
    return F.year(col).cast("long")


# --- M04, N08 ---------------------------------------------------------------

ATTRIBUTION_COLS = ("fully_attributed", "partial", "unattributable", "total_flagged")


def attribution_counts() -> list[F.Column]:
    """Flagged items by how far they trace to a campaign (aggregate columns)."""
    flag = F.col("is_campaign") == 1
    camp = F.col("campaign_id").isNotNull()
    enrolled = F.col("product_campaign_id").isNotNull()
    return [F.count(F.when(flag & camp & enrolled, 1)).alias("fully_attributed"),
            F.count(F.when(flag & camp & ~enrolled, 1)).alias("partial"),
            F.count(F.when(flag & ~camp, 1)).alias("unattributable"),
            F.count(F.when(flag, 1)).alias("total_flagged")]


def attribution_audit(t: Tables) -> DataFrame:
    """Flagged items by how far they can be traced to a campaign.

    The counts are additive, so they are summed from the shared monthly
    summary (one scan of the item fact for several metrics).
    """
    from .marts import monthly_summary

    m = monthly_summary(t)
    return m.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ATTRIBUTION_COLS])


def attribution_share(t: Tables) -> DataFrame:
    """Share of flagged items that are fully attributed."""
    a = attribution_audit(t)
    return a.select("fully_attributed", "total_flagged",
                    pct("fully_attributed", "total_flagged", 1).alias("share_pct"))


# --- lift: M05, M06, N07, N12, N13 -----------------------------------------------

def campaign_lift(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS,
                  measure: str = "gmv") -> DataFrame:
    """Per campaign: ROUND(GMV / calendar days / baseline median, 2).

    ``measure='realized'`` uses completed GMV in the numerator and the median
    daily completed GMV of the same baseline days in the denominator (N12).
    """
    base_col = "daily_gmv" if measure == "gmv" else "daily_realized_gmv"
    base = baseline_median_gmv(t, min_daily_items, base_col)
    g = campaign_summary(t).withColumn("amount", F.col("gmv" if measure == "gmv" else "realized"))
    lift = F.round(F.col("amount") / inclusive_days() / base.scalar(), 2)
    return g.select(*CAMPAIGN_COLS, campaign_year().alias("campaign_year"), lift.alias("lift"))


def lift_by_campaign(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """GMV lift of each campaign over the median non-campaign day."""
    return campaign_lift(t, min_daily_items).select(
        "campaign_name", "campaign_type", "campaign_year", F.col("lift").alias("gmv_lift")
    ).orderBy(asc("campaign_type"), desc("gmv_lift"))


def lift_by_campaign_type(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Per mechanic, mean / median / min / max of the rounded campaign lifts."""
    lift = F.col("lift")
    return (campaign_lift(t, min_daily_items).groupBy("campaign_type").agg(
        F.count(F.lit(1)).alias("n_campaigns"),
        dbl(avg_exact(lift.cast("decimal(20,2)"), 2), 2).alias("mean_lift"),
        median_out(F.percentile(lift, F.lit(0.5))).alias("median_lift"),
        dbl(F.min(lift), 2).alias("min_lift"),
        dbl(F.max(lift), 2).alias("max_lift"))).orderBy(desc("median_lift"))


def threshold_sensitivity(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Median lift per mechanic with and without the minimum-volume filter."""
    def med(n: int, name: str) -> DataFrame:
        return campaign_lift(t, n).groupBy("campaign_type").agg(
            F.percentile("lift", F.lit(0.5)).alias(name))
    j = join_null_safe(med(min_daily_items, "f"), med(0, "u"), ["campaign_type"])
    # Medians of 2-place lifts have at most 3 places: exact as decimals.
    f, u = F.col("f").cast("decimal(20,3)"), F.col("u").cast("decimal(20,3)")
    return j.select("campaign_type",
                    median_out("f").alias("median_lift_filtered"),
                    median_out("u").alias("median_lift_unfiltered"),
                    pct(u - f, f, 1, 3, 3).alias("overstatement_pct"))


def realized_lift(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Lift on completed GMV (numerator and baseline) beside the booked lift."""
    b = campaign_lift(t, min_daily_items).select("campaign_id", F.col("lift").alias("b"))
    r = campaign_lift(t, min_daily_items, "realized").select("campaign_id", F.col("lift").alias("r"))
    bd, rd = F.col("b").cast("decimal(20,2)"), F.col("r").cast("decimal(20,2)")
    return b.join(r, "campaign_id").select(
        "campaign_id", dbl("b").alias("booked_lift"), dbl("r").alias("realized_lift"),
        pct(rd - bd, bd, 1, 2, 2).alias("change_pct"))


def below_baseline_campaigns(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Per mechanic, campaigns below and at-or-above a normal day (lift 1)."""
    lift = F.col("lift")
    return campaign_lift(t, min_daily_items).groupBy("campaign_type").agg(
        F.count(F.when(lift < 1, 1)).alias("below"),
        F.count(F.when(lift >= 1, 1)).alias("at_or_above"))


# --- M07 ----------------------------------------------------------------------

def _sessions_and_conversions(s: DataFrame, *keys: str) -> DataFrame:
    """``total_sessions`` and ``conv`` per key, from one row per session first (no Expand)."""
    per_session = s.groupBy(*keys, "session_id").agg(
        F.max(F.col("order_id").isNotNull()).alias("_bought"))
    return per_session.groupBy(*keys).agg(
        F.count("session_id").alias("total_sessions"),
        F.count(F.when(F.col("_bought"), F.col("session_id"))).alias("conv"))


def campaign_cvr_and_lift(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Conversion and lift seen from the session side, per name/type/window.

    Sessions decide the campaign; the orders they reached bring their items,
    so an order reached by two sessions counts twice (as in the source).
    Sessions are first counted per (campaign, order key), stored, and the items
    joined to those counts as weights: sessions without an order never enter a
    join, and a Bloom filter of the reached order keys drops most other items
    in their scan, before the exchange (``plans/bloom.py``; while its proven
    size allows). The text order key is cast
    leniently (``try_cast``); non-numeric text converts to NULL instead of
    failing and is reported by ``fk_orphans``.
    """
    base = baseline_median_gmv(t, min_daily_items)
    c = t.campaigns_small().select(*CAMPAIGN_COLS)
    run = ["campaign_name", "campaign_type", "start_date", "end_date"]
    s = (t.website_sessions.where(F.col("campaign_id").isNotNull())
           .select("session_id", "campaign_id", "order_id").join(c, "campaign_id"))
    found = (s.withColumn("_okey", F.col("order_id").try_cast("long"))
              .where(F.col("_okey").isNotNull())
              .groupBy(*run, "_okey").agg(F.count(F.lit(1)).alias("_times")))
    reached = t.shared("reached_orders", lambda: materialize(found, "reached-orders"))
    items = t.item_orders().select(F.col("order_id").alias("_okey"), "line_total", revenue_expr().alias("_rev"))
    items = might_match(items, "_okey", reached, "_okey", reached.count())
    times = F.col("_times").cast("decimal(12,0)")
    money = items.join(reached, "_okey").groupBy(*run).agg(
        F.sum(F.col("line_total") * times).alias("gmv"), F.sum(F.col("_rev") * times).alias("rev"))
    g = join_null_safe(_sessions_and_conversions(s, *run), money, run, "left")
    return g.select(
        "campaign_name", "campaign_type", campaign_year().alias("campaign_year"),
        "total_sessions", F.col("conv").alias("converted_sessions"),
        pct("conv", "total_sessions", 2).alias("cvr_pct"),
        dbl("gmv", 0).alias("total_gmv"),
        dbl("rev", 0).alias("platform_revenue"),
        F.round(F.col("gmv") / inclusive_days() / base.scalar(), 2).alias("corrected_lift")
    ).orderBy(asc("campaign_name"))


def campaign_cvr(t: Tables) -> DataFrame:
    """Sessions and conversion per session campaign_id (for the main mart)."""
    s = t.website_sessions.where(F.col("campaign_id").isNotNull())
    g = _sessions_and_conversions(s, "campaign_id")
    return g.select("campaign_id", pct("conv", "total_sessions", 2).alias("cvr_pct"), "total_sessions")


# --- M09, N03 -----------------------------------------------------------------------

def _campaign_year_revenue(t: Tables) -> DataFrame:
    """Per campaign year: campaigns, buyers and revenue, from the stored campaign tables (no scan of the items)."""
    years = t.campaigns_small().select("campaign_id", campaign_year().alias("year"))
    buyers = (campaign_orders(t).select("campaign_id", "customer_id").where(F.col("customer_id").isNotNull())
              .join(years, "campaign_id").groupBy("year", "customer_id").agg(F.lit(1).alias("_one"))
              .groupBy("year").agg(F.count(F.lit(1)).alias("unique_buyers")))
    totals = campaign_summary(t).groupBy(campaign_year().alias("year")).agg(
        F.count_distinct("campaign_id").alias("campaigns"), F.round(F.sum("rev"), 0).alias("campaign_revenue"))
    return join_null_safe(totals, buyers, ["year"], "left").select(
        "year", "campaigns", F.coalesce("unique_buyers", F.lit(0)).alias("unique_buyers"), "campaign_revenue")


def yearly_revenue_growth(t: Tables) -> DataFrame:
    """Campaign revenue and buyers per campaign year beside all revenue of that year."""
    from .marts import monthly_summary      # months roll up exactly into years

    ao = monthly_summary(t).groupBy(F.col("order_year").alias("year")).agg(
        F.round(F.sum("rev"), 0).alias("total_platform_revenue"))
    # One row per year: a single-partition window is bounded by the calendar.
    co = _campaign_year_revenue(t).withColumn(
        "rev_before", F.lag("campaign_revenue").over(Window.orderBy("year")))
    j = co.join(ao, "year")
    return j.select(
        "year", "campaigns", "unique_buyers",
        dbl("campaign_revenue").alias("campaign_revenue"),
        dbl("total_platform_revenue").alias("total_platform_revenue"),
        pct(F.col("campaign_revenue") - F.col("rev_before"), "rev_before", 1)
        .alias("yoy_revenue_growth_pct")).orderBy(asc("year"))


def programme_growth(t: Tables) -> DataFrame:
    """First vs last campaign year: revenue growth and buyer fold."""
    y = _campaign_year_revenue(t)
    a = y.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"),
              F.min_by("campaign_revenue", "year").alias("fr"),
              F.max_by("campaign_revenue", "year").alias("lr"),
              F.min_by("unique_buyers", "year").alias("fb"),
              F.max_by("unique_buyers", "year").alias("lb"))
    return a.select(
        "first_year", "last_year",
        dbl("fr").alias("first_revenue"), dbl("lr").alias("last_revenue"),
        pct(F.col("lr") - F.col("fr"), "fr", 1).alias("revenue_growth_pct"),
        dbl(exact_div("lb", "fb"), 1).alias("buyer_fold"))


# --- leakage: M11, M12, M13, N05, N09 ------------------------------------------------

def _leakage_per_campaign(t: Tables) -> DataFrame:
    return campaign_summary(t).select("campaign_id", "campaign_name", "campaign_type", "start_date",
                                      "gmv", "realized", "leaked", "rev")


def leakage_vs_baseline(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Campaign leakage (value-weighted) against the baseline (item-count rate).

    The two rates are weighted differently, as in the source; the gap mixes
    them. No campaign rows -> no output row.
    """
    base = daily_non_campaign(t, min_daily_items).agg(
        F.percentile("daily_leakage", F.lit(0.5)).alias("b"))
    cl = _leakage_per_campaign(t).select(
        F.round(exact_div("leaked", "gmv", 2, 2, mult=100), 2).alias("leakage_pct"),
        F.round(F.col("gmv") - F.col("realized"), 0).alias("leaked_amt"))
    lp = F.col("leakage_pct")
    g = cl.withColumn("b", base.scalar()).groupBy("b").agg(
        avg_exact(lp, 2).alias("mean"),
        F.percentile(lp, F.lit(0.5)).alias("med"),
        F.min(lp).alias("mn"), F.max(lp).alias("mx"),
        F.sum("leaked_amt").alias("total"))
    return g.select(
        dbl("mean", 2).alias("campaign_mean_leakage"),
        median_out("med").alias("campaign_median_leakage"),
        dbl("mn").alias("min_leakage"), dbl("mx").alias("max_leakage"),
        median_out("b").alias("baseline_median_leakage"),
        median_out(F.col("med") - F.col("b")).alias("median_gap_pp"),
        dbl("total", 0).alias("total_leaked_gmv"))


def campaign_gmv_totals(t: Tables) -> DataFrame:
    """Total, realized, leaked (total - completed) GMV and revenue of campaign orders."""
    io = t.item_orders(campaign=True)
    a = io.agg(F.sum("line_total").alias("gmv"), F.sum(completed_amount()).alias("realized"),
               F.sum(revenue_expr()).alias("rev"))
    return a.select(dbl("gmv", 0).alias("total_campaign_gmv"),
                    dbl("realized", 0).alias("realized_gmv"),
                    dbl(F.col("gmv") - F.col("realized"), 0).alias("total_leaked_gmv"),
                    dbl("rev", 0).alias("platform_revenue"))


def campaign_leakage_detail(t: Tables) -> DataFrame:
    """Per campaign GMV, realized, leaked (Cancelled/Refunded), leakage %, revenue."""
    return _leakage_per_campaign(t).select(
        "campaign_name", "campaign_type", campaign_year().alias("campaign_year"),
        dbl("gmv", 0).alias("total_gmv"),
        dbl("realized", 0).alias("realized_gmv"),
        dbl("leaked", 0).alias("leaked_gmv"),
        pct("leaked", "gmv", 2, 2, 2).alias("leakage_pct"),
        dbl("rev", 0).alias("platform_revenue")).orderBy(asc("campaign_year"), asc("campaign_name"))


def leakage_sensitivity(t: Tables) -> DataFrame:
    """Campaign GMV and the GMV that one point of leakage is worth."""
    io = t.item_orders(campaign=True)
    a = io.agg(F.sum("line_total").alias("gmv"))
    return a.select(dbl("gmv", 0).alias("total_campaign_gmv"),
                    dbl(F.col("gmv") * F.lit(0.01).cast("decimal(3,2)"), 0).alias("gmv_per_point"))


def leaked_gmv_by_year(t: Tables) -> DataFrame:
    """Leaked campaign GMV (Cancelled/Refunded) and its rate per campaign year."""
    g = campaign_summary(t).groupBy(campaign_year().alias("campaign_year")).agg(
        F.sum("leaked").alias("leaked"), F.sum("gmv").alias("gmv"))
    return g.select("campaign_year", dbl("leaked", 0).alias("leaked_gmv"),
                    pct("leaked", "gmv", 2, 2, 2).alias("leakage_pct"))


def take_rate(t: Tables) -> DataFrame:
    """Platform revenue as a share of GMV over all order items."""
    a = t.order_items.agg(F.sum("line_total").alias("gmv"), F.sum(revenue_expr()).alias("rev"))
    return a.select(dbl("gmv", 0).alias("total_gmv"), dbl("rev", 0).alias("platform_revenue"),
                    pct("rev", "gmv", 2, 2, 2).alias("take_rate_pct"))


# --- N02, N14 ---------------------------------------------------------------------------

def typical_day_multiple(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Median campaign-day GMV over median baseline-day GMV, overall and per year.

    A campaign day is a date with campaign orders; its GMV is that of those
    orders. The other side is the baseline days. Each day row is counted in
    two scopes ('all' and its year), so one aggregate covers both.
    """
    cd = t.item_orders(campaign=True).groupBy("order_date").agg(F.sum("line_total").alias("c"))
    nd = daily_non_campaign(t, min_daily_items).select("order_date", F.col("daily_gmv").alias("n"))
    days = (cd.select("order_date", "c", F.lit(None).cast(cd.schema["c"].dataType).alias("n"))
              .unionByName(nd.select("order_date", F.lit(None).cast(nd.schema["n"].dataType).alias("c"), "n")))
    scoped = days.select(F.explode(F.array(F.lit("all"), F.year("order_date").cast("string"))).alias("scope"),
                         "c", "n")
    g = scoped.groupBy("scope").agg(F.percentile("c", F.lit(0.5)).alias("cm"),
                                    F.percentile("n", F.lit(0.5)).alias("nm"))
    return g.select("scope", median_out("cm").alias("campaign_median_gmv"),
                    median_out("nm").alias("non_campaign_median_gmv"),
                    dbl(F.col("cm") / F.nullif(F.col("nm"), F.lit(0.0)), 2).alias("multiple"))


def event_ranking(t: Tables) -> DataFrame:
    """Per event name over all years: years run, days, platform revenue, rank (lowest = 1)."""
    dims = t.campaigns.groupBy("campaign_name").agg(
        F.count_distinct(F.year("start_date")).alias("n_years"),
        F.sum(inclusive_days()).cast("long").alias("total_days"))
    rev = campaign_summary(t).groupBy("campaign_name").agg(F.sum("rev").alias("rev"))
    j = dims.join(rev, "campaign_name", "left").withColumn("platform_revenue", dbl("rev", 0))
    # One row per event name: the global ranking window is bounded by the names.
    return j.select("campaign_name", "n_years", "total_days", "platform_revenue",
                    F.rank().over(Window.orderBy(F.col("platform_revenue").asc_nulls_last()))
                    .cast("long").alias("revenue_rank"))
