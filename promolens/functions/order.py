"""Result order of the report queries, with PostgreSQL NULL placement.

PostgreSQL puts NULLs last in ascending order and first in descending order;
Spark does the opposite by default, so the report orderings say it
explicitly. The derived tables are not sorted (order is not a property of a
stored table).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def desc(c: str) -> Column:
    return F.col(c).desc_nulls_first()
