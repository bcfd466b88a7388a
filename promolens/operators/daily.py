"""Daily non-campaign series and everything measured on it.

Grain of the shared builder: one row per ``order_date`` of non-campaign
orders. It is a partial + final hash aggregate, so a hot day costs nothing
extra; every statistic on top works on at most one row per calendar day,
which is why the exact ``F.percentile`` is safe here.

Keys: M01 threshold_diagnostics, M02 gmv_baseline_distribution,
M03 leakage_baseline, M26 fact_daily_baseline, N01 baseline_skewness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (CANCELLED, IQR_K, LEAK_STATUSES, MIN_DAILY_ITEMS,
                               avg_exact, completed_amount, dbl, median_out, rate_flag)
from ..functions.percentile import small_percentiles
from ..plans.materialize import materialize
from ..sources.tables import Tables


def daily_non_campaign(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Per day of non-campaign orders: GMV, item count, cancel and leakage rates.

    Days with fewer than ``min_daily_items`` order items are dropped
    (``HAVING COUNT(order_item_id) >= n``; 0 keeps every day). The rates are
    item-count rates in percent, computed in double.

    The unfiltered series (one row per calendar day) is built once per table
    bundle and stored under the checkpoint folder: a dozen metrics read it,
    and building it is a scan of every non-campaign item.
    """
    d = t.shared("daily_non_campaign", lambda: materialize(_daily_all(t), "daily-non-campaign"))
    if min_daily_items > 0:
        d = d.where(F.col("daily_items") >= min_daily_items)
    return d


def _daily_all(t: Tables) -> DataFrame:
    status = F.col("item_status")
    return (t.item_orders(campaign=False)
              .groupBy("order_date")
              .agg(F.sum("line_total").alias("daily_gmv"),
                   F.sum(completed_amount()).alias("daily_realized_gmv"),
                   F.count("order_item_id").alias("daily_items"),
                   (F.avg(rate_flag(status == CANCELLED)) * 100).alias("daily_cancel"),
                   (F.avg(rate_flag(status.isin(*LEAK_STATUSES))) * 100).alias("daily_leakage")))


def baseline_median_gmv(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS,
                        measure: str = "daily_gmv") -> DataFrame:
    """One row: the median daily GMV of baseline days (NULL when there are none)."""
    d = daily_non_campaign(t, min_daily_items)
    return d.agg(F.percentile(measure, F.lit(0.5)).alias("median_gmv"))


def threshold_diagnostics(t: Tables, iqr_k: float = IQR_K) -> DataFrame:
    """Candidate minimum-volume cuts over daily item counts (no cut applied)."""
    d = daily_non_campaign(t, min_daily_items=0)
    x = F.col("daily_items")
    q = d.agg(
        *small_percentiles(x, {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75}),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.count(F.lit(1)).alias("total_days"),
        F.min(x).alias("min_daily_items"), F.max(x).alias("max_daily_items"),
        avg_exact(x, 0).alias("mean_exact"))
    return q.select(
        median_out("p5").alias("p5_threshold"),
        median_out(F.col("q1") - F.lit(iqr_k) * (F.col("q3") - F.col("q1"))).alias("iqr_lower_fence"),
        dbl(F.col("mean") - 2 * F.col("sd"), 0).alias("mean_minus_2sd"),
        "total_days", "min_daily_items",
        dbl("mean_exact", 1).alias("mean_daily_items"),
        median_out("median").alias("median_daily_items"),
        "max_daily_items",
        median_out("q1").alias("q1"),
        median_out("q3").alias("q3"),
    )


def gmv_baseline_distribution(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Spread of daily non-campaign GMV on baseline days."""
    d = daily_non_campaign(t, min_daily_items)
    g = F.col("daily_gmv")
    q = d.agg(avg_exact(g, 2).alias("mean"),
              *small_percentiles(g, {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9}),
              F.min(g).alias("mn"), F.max(g).alias("mx"),
              F.count(F.lit(1)).alias("days_used"))
    return q.select(
        dbl("mean", 0).alias("mean_daily_gmv"),
        median_out("median").alias("median_daily_gmv"),
        dbl("mn", 0).alias("min_daily_gmv"),
        dbl("mx", 0).alias("max_daily_gmv"),
        median_out("p25").alias("p25"),
        median_out("p75").alias("p75"),
        median_out("p90").alias("p90"),
        "days_used",
    )


def leakage_baseline(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Mean and median of daily cancel and leakage rates (by item count)."""
    d = daily_non_campaign(t, min_daily_items)
    q = d.agg(F.avg("daily_cancel").alias("cm"),
              F.percentile("daily_cancel", F.lit(0.5)).alias("cmed"),
              F.avg("daily_leakage").alias("lm"),
              F.percentile("daily_leakage", F.lit(0.5)).alias("lmed"))
    return q.select(dbl("cm", 3).alias("cancel_mean"),
                    median_out("cmed").alias("cancel_median"),
                    dbl("lm", 3).alias("leakage_mean"),
                    median_out("lmed").alias("leakage_median"))


def fact_daily_baseline(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """The one-row constants table (median and mean GMV, median rates, days)."""
    d = daily_non_campaign(t, min_daily_items)
    q = d.agg(F.percentile("daily_gmv", F.lit(0.5)).alias("mg"),
              avg_exact("daily_gmv", 2).alias("ag"),
              F.percentile("daily_leakage", F.lit(0.5)).alias("ml"),
              F.percentile("daily_cancel", F.lit(0.5)).alias("mc"),
              F.count(F.lit(1)).alias("days_used"))
    return q.select(median_out("mg").alias("median_daily_gmv"),
                    dbl("ag", 0).alias("mean_daily_gmv"),
                    median_out("ml").alias("median_leakage_rate_pct"),
                    median_out("mc").alias("median_cancel_rate_pct"),
                    "days_used")


def baseline_skewness(t: Tables, min_daily_items: int = MIN_DAILY_ITEMS) -> DataFrame:
    """Right skew of daily GMV, near symmetry of the daily rates.

    Skewness is the population form (third central moment over the 1.5th
    power of the second), as ``F.skewness`` computes it.
    """
    d = daily_non_campaign(t, min_daily_items)
    g = F.col("daily_gmv").cast("double")
    q = d.agg(F.avg(g).alias("mean"), F.percentile(g, F.lit(0.5)).alias("median"),
              F.skewness(g).alias("sg"), F.skewness("daily_leakage").alias("sl"),
              F.skewness("daily_cancel").alias("sc"))
    return q.select(
        dbl("mean", 0).alias("mean_daily_gmv"),
        median_out("median").alias("median_daily_gmv"),
        dbl((F.col("mean") - F.col("median")) / F.nullif(F.col("median"), F.lit(0.0)) * 100, 1)
        .alias("mean_over_median_pct"),
        dbl("sg", 4).alias("skew_gmv"),
        dbl("sl", 4).alias("skew_leakage"),
        dbl("sc", 4).alias("skew_cancel"),
    )
