"""Rounding contract: ROUND(a * 100 / b, n) half away from zero, exact, in Spark and in the oracle."""

import random
from decimal import ROUND_HALF_UP, Decimal

import duckdb
from pyspark.sql import types as T

from promolens.functions.exprs import pct
from promolens.plans.oracle import xr


def expected(a: int, b: int, n: int, scale: int):
    if b == 0:
        return None
    v = Decimal(a) / Decimal(b) * 100                      # a and b carry the same scale
    q = Decimal(1).scaleb(-n)
    return float(v.quantize(q, rounding=ROUND_HALF_UP)) if v >= 0 else \
        -float((-v).quantize(q, rounding=ROUND_HALF_UP))


def cases():
    rnd = random.Random(11)
    out = []
    for n in (0, 1, 2):
        for _ in range(150):
            b = rnd.choice([8, 16, 32, 40, 80, 125, 160, 400, 800, 2000, rnd.randint(1, 10 ** 9)])
            a = rnd.randint(-10 ** 9, 10 ** 9)
            out.append((a, b, n))
        # exact ties at the rounding digit: a / b * 100 = k + 5 / 10^(n+1)
        for k in range(40):
            b = 2 * 10 ** (n + 3)
            a = (k * 10 ** (n + 1) + 5) * b // (100 * 10 ** (n + 1))
            out.append((a, b, n))
            out.append((-a, b, n))
        out.append((5, 0, n))
    # Just below, on and above a tie, for denominators far beyond twelve digits of the quotient.
    for n in (0, 1, 2):
        for e in range(10, 16):
            b = 2 * 10 ** (n + 2) * 10 ** (e - n - 2)
            tie = b // (2 * 10 ** (n + 2)) * 3
            out += [(tie + d, b, n) for d in (-1, 0, 1)] + [(-tie + d, b, n) for d in (-1, 0, 1)]
    out += [(1000000, 20000000001, 2), (500000000, 1000000000001, 1)]
    return out


def test_spark_pct_matches_decimal(spark):
    rows = cases()
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                           T.StructField("n", T.IntegerType())])
    df = spark.createDataFrame(rows, schema)
    got = {}
    for n in (0, 1, 2):
        for r in df.where(f"n = {n}").select("a", "b", pct("a", "b", n).alias("v")).collect():
            got[(r["a"], r["b"], n)] = r["v"]
    for a, b, n in rows:
        assert got[(a, b, n)] == expected(a, b, n, 0), (a, b, n)


def test_oracle_xr_matches_decimal():
    con = duckdb.connect()
    for a, b, n in cases():
        v = con.execute(f"SELECT {xr(str(a), str(b), n)}").fetchone()[0]
        assert v == expected(a, b, n, 0), (a, b, n)
