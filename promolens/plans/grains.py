"""Two-level aggregation: distinct counts without expanding the rows.

``count_distinct`` on two columns makes Spark copy every input row once per column (Expand) before the
shuffle. Here the rows are first added up to one row per (group, identifier), a partial aggregate on the
map side, and the identifiers are counted on that far smaller table. Sums of sums keep their type, so a
metric built this way reads like one built in a single step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_identifier(df: DataFrame, keys: list[Column | str], ident: list[str], measures: list[Column]) -> DataFrame:
    """One row per (keys, ident) with the aggregated ``measures``."""
    return df.groupBy(*keys, *ident).agg(*measures)


def add_up(df: DataFrame, columns: list[str]) -> list[Column]:
    """Sums of already aggregated columns under their own names and types."""
    return [F.sum(c).cast(df.schema[c].dataType).alias(c) for c in columns]


def day_mask(date: Column | str) -> Column:
    """The days seen, as a bit mask of days of the month (for groups within one month)."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth(date)))


def days_in(mask: Column | str) -> Column:
    """Number of distinct days in a :func:`day_mask`; 0 if every date was NULL."""
    return F.coalesce(F.bit_count(mask), F.lit(0)).cast("long")
