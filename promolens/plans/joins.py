"""Join helpers: size-checked broadcast and NULL-safe equality.

* ``bounded_broadcast`` only hints a broadcast when the side is proven small,
  either by construction (``known_max_rows``) or by a cheap ``limit(n+1).count()``
  probe. Beyond the bound the join is left to the planner (sort-merge, or an
  AQE runtime conversion), so a dimension that grows with the data never
  gets shipped whole to every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast at most this many rows of a dimension (about 10-20 MB for the
# narrow projections used here).
DEFAULT_BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int | None = None,
                      known_max_rows: int | None = None) -> DataFrame:
    """Return ``F.broadcast(df)`` when ``df`` has at most ``max_rows`` rows
    (default ``DEFAULT_BROADCAST_ROWS``)."""
    if max_rows is None:
        max_rows = DEFAULT_BROADCAST_ROWS
    if known_max_rows is not None and known_max_rows <= max_rows:
        return F.broadcast(df)
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (SQL ``IS NOT DISTINCT FROM``).

    Used to attach per-group results back to their group when a group key
    (a product category, say) may be NULL. The key columns of ``right`` are
    dropped from the result.
    """
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys])
