"""Website session metrics: conversion, funnel, session length.

Funnel stages are a bit mask per session, built with the session's campaign and
length in one aggregate over activities and sessions together; this is the
same as grouping the session x activity join, without a join. Session-length
statistics come from one stored (session type, microseconds, count) table: a
session type holds about half of all sessions.

Keys: M16 overall_cvr, M17 funnel_dropoff, M18 session_duration,
M23 fact_funnel, N11 funnel_stage_gap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import desc
from ..functions.exprs import (CAMPAIGN, FUNNEL_STAGES, MICROS_PER_MINUTE, NON_CAMPAIGN, dbl,
                               exact_div, median_out, micros_between, pct, session_type)
from ..functions.percentile import counted_percentiles
from ..plans.grains import add_up
from ..plans.materialize import materialize
from ..sources.tables import Tables

STEP_RATIOS = [f"{a}_to_{b}" for (a, _), (b, _) in zip(FUNNEL_STAGES, FUNNEL_STAGES[1:])]


def _minutes(c: F.Column) -> F.Column:
    return c.cast("double") / MICROS_PER_MINUTE


# Microsecond totals are summed as decimals: 10^10 sessions of a quarter hour
# already pass the range of a long.


def overall_cvr(t: Tables) -> DataFrame:
    """Share of sessions with an order, campaign vs non-campaign."""
    per_session = t.website_sessions.groupBy(session_type().alias("session_type"), "session_id").agg(
        F.max(F.col("order_id").isNotNull()).alias("_bought"))      # one row per session: no Expand
    g = per_session.groupBy("session_type").agg(
        F.count("session_id").alias("total_sessions"),
        F.count(F.when(F.col("_bought"), F.col("session_id"))).alias("converted"))
    return g.select("session_type", "total_sessions", "converted",
                    pct("converted", "total_sessions", 2).alias("cvr_pct"))


def session_masks(t: Tables, stages=FUNNEL_STAGES) -> DataFrame:
    """One row per session_id that has both a session and activities.

    ``mask`` has bit i set if an activity reached stage i; ``rows`` counts the session rows of that id (1 when the key
    holds), ``n_campaign`` and ``n_other`` its distinct campaigns and whether it has none, ``us`` and ``n_us`` sum
    and number of its session lengths. Activities and sessions meet in one aggregate keyed by session_id
    (``bit_or`` joins the stages in one number, combined map-side), so neither the stage flags nor the two
    times need a join. ``stages`` is a sequence of at most 62 (name, lower-case URL fragment); the default
    is the six-stage funnel of the source. The default table is built once per bundle and stored: the two
    funnel reports and the funnel mart read it, and building it scans the activities, the largest input.
    """
    def build() -> DataFrame:
        zero = F.lit(0).cast("long")
        # Lower-case each URL once, then test every stage fragment on it.
        acts = t.session_activities.where(F.col("session_id").isNotNull()).select("session_id", F.lower("page_url").alias("url_lower"))
        bits = [F.when(F.col("url_lower").contains(pattern), F.lit(1 << i).cast("long")).otherwise(zero) for i, (_, pattern) in enumerate(stages)]
        acts = acts.select("session_id", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("mask"))
        us = micros_between("session_start_time", "session_end_time").cast("decimal(38,0)")
        sessions = t.website_sessions.where(F.col("session_id").isNotNull()).groupBy("session_id", "campaign_id").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(us).alias("us"), F.count(us).alias("n_us"))
        sessions = sessions.select("session_id", "rows", F.col("campaign_id").isNotNull().cast("long").alias("n_campaign"),
                                   F.col("campaign_id").isNull().cast("long").alias("n_other"), "us", "n_us")
        both = acts.unionByName(sessions, allowMissingColumns=True)
        return (both.groupBy("session_id").agg(F.bit_or("mask").alias("mask"), *add_up(both, ["rows", "n_campaign", "n_other", "us", "n_us"]))
                .where(F.col("mask").isNotNull() & F.col("rows").isNotNull()))
    if tuple(stages) != tuple(FUNNEL_STAGES):
        return build()
    return t.shared("session_masks", lambda: materialize(build(), "session-masks"))


def _by_type(masks: DataFrame) -> DataFrame:
    """The rows of ``masks`` once for each session type they have, with its number of distinct campaigns (1 for none)."""
    types = F.array(F.struct(F.lit(CAMPAIGN).alias("session_type"), F.col("n_campaign").alias("n")),
                    F.struct(F.lit(NON_CAMPAIGN).alias("session_type"), F.col("n_other").alias("n")))
    return masks.withColumn("_t", F.explode(types)).select("*", "_t.session_type", "_t.n").where("n > 0").drop("_t")


def _reached(weight: str) -> list[F.Column]:
    """For every stage the sum of ``weight`` over rows whose mask has its bit."""
    return [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(weight)).otherwise(0)).alias(f"s_{name}")
            for i, (name, _) in enumerate(FUNNEL_STAGES)]


def _funnel_columns(n_col: str) -> list[F.Column]:
    cols = []
    for (a, _), (b, _), name in zip(FUNNEL_STAGES, FUNNEL_STAGES[1:], STEP_RATIOS):
        cols.append(pct(f"s_{b}", f"s_{a}", 1).alias(f"{name}_pct"))
    cols.append(pct(f"s_{FUNNEL_STAGES[-1][0]}", n_col, 2).alias("overall_cvr_pct"))
    return cols


def funnel_dropoff(t: Tables) -> DataFrame:
    """Step-to-step ratios of stage reach; flags are independent, so >100 is possible."""
    g = _by_type(session_masks(t)).groupBy("session_type").agg(F.sum("n").alias("sessions"), *_reached("n"))
    return g.select("session_type", "sessions", *_funnel_columns("sessions")).orderBy(desc("session_type"))


def funnel_stage_gap(t: Tables) -> DataFrame:
    """Per funnel step, campaign vs non-campaign ratio, gap and drop-off."""
    f = funnel_dropoff(t)
    long = f.unpivot(["session_type"], [f"{s}_pct" for s in STEP_RATIOS], "stage", "pct")
    long = long.withColumn("stage", F.regexp_replace("stage", "_pct$", ""))
    c = F.max(F.when(F.col("session_type") == CAMPAIGN, F.col("pct"))).cast("decimal(10,1)")
    n = F.max(F.when(F.col("session_type") == NON_CAMPAIGN, F.col("pct"))).cast("decimal(10,1)")
    g = long.groupBy("stage").agg(c.alias("c"), n.alias("n"))
    hundred = F.lit(100).cast("decimal(10,1)")
    return g.select("stage", dbl("c").alias("campaign_pct"), dbl("n").alias("non_campaign_pct"),
                    dbl(F.col("c") - F.col("n"), 1).alias("gap_pp"),
                    dbl(hundred - F.col("c"), 1).alias("campaign_drop_pct"),
                    dbl(hundred - F.col("n"), 1).alias("non_campaign_drop_pct"))


def _length_table(rows: DataFrame, name: str, measures: list[F.Column]) -> DataFrame:
    """Stored (session_type, us, measures): every statistic of session lengths comes from it."""
    return materialize(rows.groupBy("session_type", "us").agg(*measures), name)


def _length_totals(c: str) -> list[F.Column]:
    us, n = F.col("us").cast("decimal(38,0)"), F.when(F.col("us").isNotNull(), F.col(c))
    return [F.sum((us * F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")).alias("sum_us"), F.sum(n).alias("n_us")]


def session_duration(t: Tables) -> DataFrame:
    """Minutes per session (end > start only): count, mean, median, quartiles."""
    ws = (t.website_sessions.where(F.col("session_end_time") > F.col("session_start_time"))
          .select(session_type().alias("session_type"),
                  micros_between("session_start_time", "session_end_time").alias("us")))
    lengths = _length_table(ws, "session-lengths", [F.count(F.lit(1)).alias("c")])
    g = lengths.groupBy("session_type").agg(F.sum("c").alias("sessions"), *_length_totals("c"))
    q = counted_percentiles(lengths, ["session_type"], "us", "c",
                            {"median_minutes": 0.5, "p25_minutes": 0.25, "p75_minutes": 0.75}, _minutes)
    j = g.join(q, "session_type", "left")
    return j.select("session_type", "sessions",
                    dbl(exact_div("sum_us", F.col("n_us").cast("decimal(38,0)") * MICROS_PER_MINUTE), 1).alias("mean_minutes"),
                    median_out("median_minutes").alias("median_minutes"),
                    median_out("p25_minutes").alias("p25_minutes"),
                    median_out("p75_minutes").alias("p75_minutes")).orderBy(desc("session_type"))


def fact_funnel(t: Tables) -> DataFrame:
    """The funnel plus mean and median session minutes of sessions with activity.

    Unlike M18 there is no end > start filter: NULL durations are skipped,
    zero and negative ones are kept. A session id with one row brings its length
    along; only ids that break the key go back to their rows (as in the
    source, each of their rows counts once for each of their campaigns).
    """
    typed = _by_type(session_masks(t))
    single = typed.where("rows = 1").select("session_type", "mask", "n", F.col("us").cast("long").alias("us"))
    several = typed.where("rows > 1")
    if not several.isEmpty():
        rows = t.website_sessions.select("session_id", micros_between("session_start_time", "session_end_time").alias("us"))
        single = single.unionByName(rows.join(several.drop("us"), "session_id").select("session_type", "mask", "n", "us"))
    lengths = _length_table(single, "funnel-lengths", [F.sum("n").alias("c"), *_reached("n")])
    g = lengths.groupBy("session_type").agg(F.sum("c").alias("total_sessions"), *_length_totals("c"),
                                            *[F.sum(f"s_{name}").alias(f"s_{name}") for name, _ in FUNNEL_STAGES])
    q = counted_percentiles(lengths, ["session_type"], "us", "c", {"median_session_minutes": 0.5}, _minutes)
    out = g.join(q, "session_type", "left")
    return out.select(
        "session_type", "total_sessions", *_funnel_columns("total_sessions"),
        dbl(exact_div("sum_us", F.col("n_us").cast("decimal(38,0)") * MICROS_PER_MINUTE), 1).alias("mean_session_minutes"),
        median_out("median_session_minutes").alias("median_session_minutes"))
