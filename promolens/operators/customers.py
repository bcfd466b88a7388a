"""New buyers: customers on the day of their first order.

Orders are reduced to one row per (customer, day) with the day's campaigns as a
bit mask, then to one row per customer by ``min_by``: two hash aggregates with
partial sums, so a customer with a huge order history is combined map-side.

Keys: M10 new_buyers_by_day_type (a day is 'Campaign' when any first order
that day has a campaign), M24 fact_new_buyers (one row per day and
campaign_id, so a mixed day counts in both groups).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import asc, desc
from ..functions.exprs import CAMPAIGN, NON_CAMPAIGN, avg_exact, dbl, median_out
from ..plans.joins import bounded_broadcast
from ..plans.materialize import materialize
from ..sources.tables import Tables


#: Campaigns of one day that share a mask column: bits 0-61, and bit 62 for an order without a campaign.
MASK_BITS = 62
_NO_CAMPAIGN = 1 << MASK_BITS


def _day_campaigns(t: Tables) -> DataFrame:
    """Campaigns that have orders on a date, numbered within the date: (order_date, campaign_id, word, bit).

    As many rows as dates have campaigns; the numbering window holds one date's campaigns.
    """
    days = (t.orders.where(F.col("campaign_id").isNotNull() & F.col("order_date").isNotNull())
            .groupBy("order_date", "campaign_id").agg(F.lit(1).alias("_one")))
    nth = F.row_number().over(Window.partitionBy("order_date").orderBy("campaign_id")) - 1
    return days.select("order_date", "campaign_id", nth.alias("n")).select(
        "order_date", "campaign_id", (F.col("n") / MASK_BITS).cast("int").alias("word"), (F.col("n") % MASK_BITS).alias("bit"))


def first_orders(t: Tables) -> tuple[DataFrame, DataFrame]:
    """One row per customer: the date of the first order and the set of campaigns ordered from on it; and the
    numbering of campaigns within their date.

    The set is a bit mask (``m0``, and ``m1`` ... on dates with over 62 campaigns), so both steps are plain hash
    aggregates over numbers: masks are joined by OR per (customer, date), which also combines a huge order
    history map-side, then ``min_by`` keeps the first date's mask. No distinct, no window or sort by customer.
    Built once per bundle and stored (both new-buyer metrics read it).
    """
    def build() -> tuple[DataFrame, DataFrame]:
        numbered = materialize(_day_campaigns(t), "day-campaigns")
        words = (numbered.agg(F.max("word")).first()[0] or 0) + 1
        o = t.orders.where(F.col("order_date").isNotNull()).select("customer_id", "order_date", "campaign_id")
        o = o.join(bounded_broadcast(numbered), ["order_date", "campaign_id"], "left")
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        bit = F.when(F.col("bit").isNull(), F.lit(_NO_CAMPAIGN)).otherwise(F.call_function("shiftleft", one, F.col("bit")))
        names = [f"m{w}" for w in range(words)]
        masks = [F.bit_or(F.when(F.coalesce("word", F.lit(0)) == w, bit).otherwise(zero)).alias(n) for w, n in enumerate(names)]
        per_day = o.groupBy("customer_id", "order_date").agg(*masks)
        first = per_day.groupBy("customer_id").agg(
            F.min("order_date").alias("first_date"), *[F.min_by(n, "order_date").alias(n) for n in names])
        return materialize(first, "first-orders"), numbered
    return t.shared("first_orders", build)


def _per_year(daily: DataFrame) -> DataFrame:
    nb = F.col("new_buyers")
    g = daily.groupBy(F.year("order_date").cast("long").alias("order_year"), "period_type").agg(
        F.count_distinct("order_date").alias("total_days"),
        F.sum(nb).alias("total_new_buyers"),
        avg_exact(nb, 0).alias("mean"),
        F.percentile(nb, F.lit(0.5)).alias("median"),
        F.min(nb).alias("min_daily_new_buyers"),
        F.max(nb).alias("max_daily_new_buyers"))
    return g.select("order_year", "period_type", "total_days", "total_new_buyers",
                    dbl("mean", 1).alias("mean_new_buyers_per_day"),
                    median_out("median").alias("median_new_buyers_per_day"),
                    "min_daily_new_buyers", "max_daily_new_buyers")


def _places(mask: str, word: int) -> F.Column:
    """The set bits of one mask column as (word, bit); bit 62 of the first word stands for no campaign."""
    last = MASK_BITS if word == 0 else MASK_BITS - 1
    held = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda b: F.call_function("shiftright", F.col(mask), b).bitwiseAND(F.lit(1)) == 1)
    return F.transform(held, lambda b: F.struct(F.lit(word).alias("word"), b.alias("bit")))


def new_buyers_by_day_type(t: Tables) -> DataFrame:
    """New buyers per day, days typed by MAX(campaign_id), then per year and type."""
    f, _ = first_orders(t)
    # MAX(campaign_id) IS NOT NULL == some first order that day has a campaign.
    has = [(F.col(c) if c != "m0" else F.col(c).bitwiseAND(F.lit(_NO_CAMPAIGN - 1))) != 0 for c in f.columns if c.startswith("m")]
    any_campaign = reduce(lambda a, b: a | b, has)
    daily = f.groupBy(F.col("first_date").alias("order_date")).agg(
        F.count("customer_id").alias("new_buyers"), F.max(any_campaign.cast("int")).alias("any_campaign"))
    daily = daily.withColumn("period_type",
                             F.when(F.col("any_campaign") == 1, CAMPAIGN).otherwise(NON_CAMPAIGN))
    return _per_year(daily).orderBy(asc("order_year"), desc("period_type"))


def fact_new_buyers(t: Tables) -> DataFrame:
    """As M10 but with one daily row per (date, campaign_id)."""
    f, numbered = first_orders(t)
    names = [c for c in f.columns if c.startswith("m")]
    # Customers are counted by (date, mask) first; only the few masks of a date are taken apart.
    sets = f.groupBy(F.col("first_date").alias("order_date"), *names).agg(F.count("customer_id").alias("n"))
    places = F.concat(*[_places(n, i) for i, n in enumerate(names)])
    one_each = sets.select("order_date", "n", F.explode(places).alias("at")).select("order_date", "n", "at.word", "at.bit")
    daily = one_each.join(numbered, ["order_date", "word", "bit"], "left").groupBy("order_date", "campaign_id").agg(F.sum("n").alias("new_buyers"))
    daily = daily.withColumn("period_type",
                             F.when(F.col("campaign_id").isNotNull(), CAMPAIGN).otherwise(NON_CAMPAIGN))
    return _per_year(daily)
