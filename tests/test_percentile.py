"""Exact percentiles: radix selection and F.percentile against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.functions.percentile import large_percentiles


def brute(values, weights, p):
    xs = sorted(v for v, w in zip(values, weights) for _ in range(w))
    if not xs:
        return None
    pos = (len(xs) - 1) * p
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    return xs[lo] + (pos - lo) * (xs[hi] - xs[lo])


def run(spark, rows, ps, weight=False):
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("k", T.LongType()),
                           T.StructField("w", T.LongType())])
    df = spark.createDataFrame(rows, schema)
    out = large_percentiles(df, ["g"], "k", ps, lambda c: c.cast("double"), weight="w" if weight else None,
                            map_max_keys=0)
    return {r["g"]: r for r in out.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_radix_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for g, n, lo, hi in [("a", 500, -10**12, 10**12), ("b", 300, 0, 50), (None, 200, 10**9, 10**9 + 7),
                         ("hot", 3000, -5, 10**6)]:
        rows += [(g, rnd.randint(lo, hi), rnd.randint(1, 3)) for _ in range(n)]
    rows.append(("b", None, 1))                      # NULL keys are ignored
    ps = {"p5": 0.05, "q1": 0.25, "med": 0.5, "p90": 0.9, "max": 1.0, "min": 0.0}
    for weighted in (False, True):
        got = run(spark, rows, ps, weighted)
        for g in ("a", "b", None, "hot"):
            vals = [k for gg, k, _ in rows if gg == g and k is not None]
            ws = [w if weighted else 1 for gg, k, w in rows if gg == g and k is not None]
            for name, p in ps.items():
                assert got[g][name] == pytest.approx(brute(vals, ws, p), rel=1e-12, abs=1e-9), (g, name)


def test_radix_single_value_and_empty(spark):
    got = run(spark, [("x", 42, 1)], {"m": 0.5, "p9": 0.9})
    assert got["x"]["m"] == 42.0 and got["x"]["p9"] == 42.0
    assert run(spark, [("x", None, 1)], {"m": 0.5}) == {}


def test_small_percentile_with_frequency_equals_fan_out(spark):
    """Trap T2: a weighted percentile equals the percentile over the repeated rows."""
    vals = [10.0, 20.0, 35.0, 70.0]
    fan = spark.createDataFrame([(v,) for v in vals for _ in range(3)], "v double")
    w = spark.createDataFrame([(v, 3) for v in vals], "v double, c long")
    a = fan.agg(F.percentile("v", F.lit(0.9)).alias("p")).first()["p"]
    b = w.agg(F.percentile("v", F.lit(0.9), F.col("c")).alias("p")).first()["p"]
    plain = w.agg(F.percentile("v", F.lit(0.9)).alias("p")).first()["p"]
    assert a == pytest.approx(b) and a != pytest.approx(plain)


@pytest.mark.parametrize("limit", [0, None])
def test_both_strategies_agree(spark, limit):
    rnd = random.Random(7)
    rows = [(g, rnd.randint(0, 10**7), 1) for g in ("a", "b") for _ in range(400)]
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("k", T.LongType()),
                           T.StructField("w", T.LongType())])
    df = spark.createDataFrame(rows, schema)
    out = large_percentiles(df, ["g"], "k", {"m": 0.5, "p9": 0.9}, lambda c: c.cast("double") / 100.0,
                            map_max_keys=limit)
    got = {r["g"]: r for r in out.collect()}
    for g in ("a", "b"):
        vals = [k / 100.0 for gg, k, _ in rows if gg == g]
        assert got[g]["m"] == pytest.approx(brute(vals, [1] * len(vals), 0.5), rel=1e-12)
        assert got[g]["p9"] == pytest.approx(brute(vals, [1] * len(vals), 0.9), rel=1e-12)
