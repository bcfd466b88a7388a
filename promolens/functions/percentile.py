"""Exact PERCENTILE_CONT for Spark DataFrames.

``PERCENTILE_CONT(p)``: with the ``n`` values of a group sorted, take position
``pos = (n - 1) * p`` and interpolate ``v[floor] + (pos - floor) * (v[ceil] - v[floor])``.
NULLs are ignored. Never approximate.

Two strategies:

* :func:`small_percentiles` - ``F.percentile`` (exact). It keeps a value -> count
  map per group and merges a whole group in one task, so it is used only
  where a group has a bounded number of values (one row per day, per
  campaign). Pre-aggregated counts go in as the frequency argument.
* :func:`large_percentiles` - exact selection by radix refinement, for groups
  that grow with the data (all items of a category, all sessions of a type).
  Values are encoded as an order-preserving ``long`` (cents, microseconds).
  Each round fixes 16 more bits of the wanted keys: count rows per (group,
  next 16-bit digit) among the rows that still match the known prefix,
  locate the wanted rank in those counts with a running sum, descend. Every
  round is a partial aggregate plus a window over at most 65,536 digit counts
  per group, so no task ever holds a whole group, however skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 16
DIGIT_MASK = (1 << DIGIT_BITS) - 1
# At most this many distinct (group, key) pairs go through ``F.percentile``
# (value -> count maps of a few tens of MB); larger inputs take the radix rounds.
MAP_MAX_KEYS = 1_000_000
_G = "_pgrp"   # struct column holding the group key


def small_percentiles(value: Column | str, ps: dict[str, float],
                      frequency: Column | str | None = None) -> list[Column]:
    """Aggregate columns ``F.percentile(value, p[, frequency])`` aliased by name."""
    out = []
    for name, p in ps.items():
        if frequency is None:
            out.append(F.percentile(value, F.lit(p)).alias(name))
        else:
            out.append(F.percentile(value, F.lit(p), frequency).alias(name))
    return out


def large_percentiles(df: DataFrame, by: Sequence[str], key: str, ps: dict[str, float],
                      decode: Callable[[Column], Column],
                      weight: str | None = None, map_max_keys: int | None = None) -> DataFrame:
    """Exact PERCENTILE_CONT per group over a long ``key`` column.

    Returns one row per group that has at least one non-NULL key, with the
    ``by`` columns and one double column per entry of ``ps``. ``decode`` maps
    the key back to the value (for example cents -> amount); interpolation is
    done on decoded doubles. ``weight`` is an optional long frequency column
    (each row counts ``weight`` times).

    Runs eagerly. The distinct (group, key, count) table is written under the
    checkpoint folder first; :func:`counted_percentiles` does the rest. If it has at most ``map_max_keys`` rows (default
    ``MAP_MAX_KEYS``) the percentiles are one ``F.percentile`` aggregate with
    the counts as frequencies. Otherwise the radix rounds run, each over stored
    data with its small result written too, so every round is a shallow plan.
    Keys are shifted by the global minimum and only as many 16-bit rounds run
    as the key range needs (two for amounts in cents below 2^32, three for
    session lengths in microseconds). Round results hold at most
    ``2 * len(ps)`` rows per group; the planner broadcasts them by their
    file size.
    """
    from ..plans.materialize import materialize

    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    # Distinct keys with their multiplicity: duplicates collapse map-side.
    counts = materialize(df.where(F.col(key).isNotNull()).groupBy(*by, F.col(key).cast("long").alias("_key"))
                         .agg(F.sum(w).alias("_count")), "pct-keys")
    return counted_percentiles(counts, by, "_key", "_count", ps, decode, map_max_keys)


def counted_percentiles(counts: DataFrame, by: Sequence[str], key: str, count: str, ps: dict[str, float],
                        decode: Callable[[Column], Column], map_max_keys: int | None = None) -> DataFrame:
    """:func:`large_percentiles` of a stored table that holds (group, key, count) already.

    The same table can carry sums for the siblings of a percentile (count, total, maximum), so that
    all of them come from one pass over the rows. A NULL key is ignored; a (group, key) may occur in several rows.
    """
    from ..plans.materialize import materialize

    by = list(by)
    # All rounds are keyed by one struct column: a struct with NULL fields is
    # itself non-NULL and equal to its copy, so NULL group keys survive joins.
    gk = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("_g0"))
    vc = counts.where(F.col(key).isNotNull()).select(gk.alias(_G), F.col(key).cast("long").alias("_k"), F.col(count).cast("long").alias("_c"))
    lo_hi = vc.agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if lo_hi["lo"] is None:
        return counts.select(*by, *[F.lit(None).cast("double").alias(n) for n in ps]).where(F.lit(False))
    if lo_hi["n"] <= (MAP_MAX_KEYS if map_max_keys is None else map_max_keys):
        v = decode(F.col("_k"))
        out = vc.groupBy(_G).agg(*[F.percentile(v, F.lit(float(p)), F.col("_c")).alias(name)
                                   for name, p in ps.items()])
        return out.select(*[F.col(f"{_G}.{b}").alias(b) for b in by], *ps.keys())
    kmin = lo_hi["lo"]
    bits = max(1, (lo_hi["hi"] - kmin).bit_length())
    if bits > 63:
        raise ValueError("key range exceeds 63 bits; encode the value with a coarser unit")
    rounds = -(-bits // DIGIT_BITS)
    off = F.col("_k") - F.lit(kmin)
    g = [_G]

    # Round 0 histogram over the top digit; it also yields the group sizes.
    shift = DIGIT_BITS * (rounds - 1)
    h0 = vc.groupBy(_G, F.shiftright(off, shift).alias("_d")).agg(F.sum("_c").alias("_cnt"))
    h0 = materialize(h0.withColumn("_n", F.sum("_cnt").over(Window.partitionBy(_G))), "pct-h0")

    # Targets: for each p, the ranks floor(pos) and ceil(pos), pos = (n - 1) * p.
    pos_cols = []
    for i, p in enumerate(ps.values()):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        pos_cols.append(F.struct(F.lit(i).alias("_pi"), pos.alias("_pos")))
    targets = (h0.select(_G, "_n").distinct()
                 .select(_G, F.explode(F.array(*pos_cols)).alias("_t"))
                 .select(_G, "_t._pi", "_t._pos",
                         F.floor("_t._pos").cast("long").alias("_rlo"),
                         F.ceil("_t._pos").cast("long").alias("_rhi")))
    ranks = (targets.select(_G, F.explode(F.array("_rlo", "_rhi")).alias("_rank")).distinct()
                    .withColumn("_rem", F.col("_rank")))

    # Walk down the digits. ``_pre`` is offset >> shift for the rows still in
    # play, ``_rem`` the rank left to find among them.
    found = materialize(_pick(h0, ranks, g, [], "_d")
                        .withColumnRenamed("_d", "_pre"), "pct-r0")
    while shift > 0:
        prev_shift, shift = shift, shift - DIGIT_BITS
        live = found.select(_G, "_pre").distinct()
        sel = (vc.withColumn("_pre", F.shiftright(off, prev_shift))
                 .join(live, [_G, "_pre"], "left_semi"))
        digit = F.shiftright(off, shift).bitwiseAND(F.lit(DIGIT_MASK))
        h = sel.groupBy(_G, "_pre", digit.alias("_d")).agg(F.sum("_c").alias("_cnt"))
        nxt = _pick(h, found, g, ["_pre"], "_d")
        found = materialize(nxt.select(
            _G, "_rank", "_rem",
            F.shiftleft("_pre", DIGIT_BITS).bitwiseOR(F.col("_d")).alias("_pre")), "pct-r")
    keys = found.select(_G, "_rank", decode(F.col("_pre") + F.lit(kmin)).alias("_v"))

    lo = keys.select(_G, F.col("_rank").alias("_rlo"), F.col("_v").alias("_vlo"))
    hi = keys.select(_G, F.col("_rank").alias("_rhi"), F.col("_v").alias("_vhi"))
    vals = (targets.join(lo, [_G, "_rlo"]).join(hi, [_G, "_rhi"])
                   .withColumn("_frac", F.col("_pos") - F.col("_rlo").cast("double"))
                   .withColumn("_v", F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))))
    out = vals.groupBy(_G).agg(*[
        F.max(F.when(F.col("_pi") == i, F.col("_v"))).alias(name)
        for i, name in enumerate(ps.keys())])
    return out.select(*[F.col(f"{_G}.{b}").alias(b) for b in by], *ps.keys())


def _pick(hist: DataFrame, want: DataFrame, by: list[str], extra: list[str], digit: str) -> DataFrame:
    """Join wanted ranks to a digit histogram and keep the digit holding each rank.

    ``hist`` has (by, extra, digit, _cnt); ``want`` has (by, extra, _rank, _rem).
    Returns (by, extra, _rank, digit, _rem) with ``_rem`` now relative to the digit.
    """
    part = [*by, *extra]
    cum = F.sum("_cnt").over(Window.partitionBy(*part).orderBy(digit)
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = hist.select(*part, digit, "_cnt", cum.alias("_cum"))
    j = h.join(want.select(*part, "_rank", "_rem"), part)
    j = j.where((F.col("_rem") >= F.col("_cum") - F.col("_cnt")) & (F.col("_rem") < F.col("_cum")))
    return j.select(*part, "_rank", digit, (F.col("_rem") - (F.col("_cum") - F.col("_cnt"))).alias("_rem"))
