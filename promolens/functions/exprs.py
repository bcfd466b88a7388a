"""Column expressions shared by the metric builders.

The source SQL is PostgreSQL: ``numeric / numeric`` is an exact decimal, and
``ROUND`` rounds half away from zero. Spark reproduces that with decimal
arithmetic and ``F.round`` (HALF_UP); every divisor is guarded with NULLIF,
which is also what ANSI mode needs. Outputs follow one type contract:
counts and years are ``long``, amounts, percentages and medians ``double``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the source definitions.
COMPLETED = "Completed"
CANCELLED = "Cancelled"
LEAK_STATUSES = ("Cancelled", "Refunded")
DOCUMENTED_STATUSES = ("Completed", "Cancelled", "Refunded")
CAMPAIGN, NON_CAMPAIGN = "Campaign", "Non-campaign"
MIN_DAILY_ITEMS = 18          # minimum order items for a baseline day
IQR_K = 1.5
# Funnel stages in order, with the lower-case text their page URL contains.
FUNNEL_STAGES = (
    ("home", "home"),
    ("product", "product"),
    ("cart", "cart"),
    ("checkout", "checkout"),
    ("billing", "billing"),
    ("purchase", "thank"),
)
MICROS_PER_MINUTE = 60_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c, n: int | None = None) -> Column:
    """Round half up to ``n`` places (if given) and return a double."""
    c = col(c)
    return (F.round(c, n) if n is not None else c).cast("double")


def median_out(c) -> Column:
    """Unrounded percentile output: a double fixed to 6 places (type contract)."""
    return F.round(col(c).cast("double"), 6)


def exact_div(num, den, num_scale: int = 0, den_scale: int = 0, mult: int = 1) -> Column:
    """``num * mult / den`` as a decimal with at least 12 fractional digits.

    NULL when ``den`` is 0 or NULL (NULLIF guard).
    """
    n = col(num)
    if mult != 1:
        n = n * F.lit(mult)
    n = n.cast(f"decimal(26,{num_scale})")
    d = col(den).cast(f"decimal(22,{den_scale})")
    return n / F.nullif(d, F.lit(0).cast(f"decimal(22,{den_scale})"))


def pct(num, den, n: int, num_scale: int = 0, den_scale: int = 0) -> Column:
    """ROUND(num / NULLIF(den, 0) * 100, n), rounded half away from zero once, in integers; a double."""
    whole = "decimal(38,0)"
    a = (col(num).cast(f"decimal(26,{num_scale})") * F.lit(10 ** num_scale)).cast(whole)
    b = (col(den).cast(f"decimal(22,{den_scale})") * F.lit(10 ** den_scale)).cast(whole)
    top = (F.abs(a) * F.lit(100 * 10 ** (n + max(0, den_scale - num_scale)))).cast(whole)
    base = F.nullif((F.abs(b) * F.lit(10 ** max(0, num_scale - den_scale))).cast(whole), F.lit(0).cast(whole))
    units = F.call_function("div", (top * 2 + base).cast(whole), (base * 2).cast(whole)).cast("double")
    return F.when((a < 0) != (b < 0), -units).otherwise(units) / F.lit(float(10 ** n)) + F.lit(0.0)


def avg_exact(c, scale: int) -> Column:
    """AVG of a decimal (or integer, scale 0) column without intermediate rounding."""
    c = col(c)
    return exact_div(F.sum(c.cast(f"decimal(22,{scale})")), F.count(c), scale, 0)


def inclusive_days(start="start_date", end="end_date") -> Column:
    """``end - start + 1`` in days: the calendar length of a campaign window."""
    return F.datediff(col(end), col(start)) + 1


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def minutes_between(start, end) -> Column:
    """EXTRACT(EPOCH FROM end - start) / 60, with fraction; NULL if either is NULL."""
    return micros_between(start, end).cast("double") / MICROS_PER_MINUTE


def session_type(campaign_id="campaign_id") -> Column:
    return F.when(col(campaign_id).isNotNull(), CAMPAIGN).otherwise(NON_CAMPAIGN)


def completed_amount(amount="line_total", status="item_status") -> Column:
    return F.when(col(status) == COMPLETED, col(amount)).otherwise(F.lit(0))


def leaked_in_amount(amount="line_total", status="item_status") -> Column:
    """Leaked GMV, first form: status IN (Cancelled, Refunded)."""
    return F.when(col(status).isin(*LEAK_STATUSES), col(amount)).otherwise(F.lit(0))


def rate_flag(cond: Column) -> Column:
    """CASE WHEN cond THEN 1.0 ELSE 0 END, as a double (not a 1-digit decimal)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def stage_flag(pattern: str, lowered_url="url_lower") -> Column:
    """MAX(CASE WHEN LOWER(url) LIKE '%pattern%' THEN 1 ELSE 0 END), over an already lower-cased URL."""
    return F.max(F.when(col(lowered_url).contains(pattern), 1).otherwise(0))


def item_cents(c) -> Column:
    """A 2-place decimal of at most 14 digits as its unscaled long: exact by way of a double (10^14 is far below 2^53), and cheaper."""
    return F.floor(col(c).cast("double") * 100 + 0.5)


def cents(c) -> Column:
    """A 2-place decimal as its unscaled long (order preserving)."""
    return (col(c) * 100).cast("long")
