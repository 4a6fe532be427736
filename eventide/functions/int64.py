"""int64 event-time arithmetic as Spark column expressions.

Spark 4 runs with ANSI on, so a plain ``+`` that overflows raises. The window
operator needs three distinct overflow behaviours: saturating (cleanup time),
"no result" (window start/end that do not fit) and Java wrap-around (the
element lateness test, which is not saturated).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.plans.spec import LONG_MAX, LONG_MIN

TWO_64 = 2**64


def lit_long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def saturating_add(a: Column, b: Column | int) -> Column:
    """``a + b`` clamped to LONG_MAX on positive overflow (b >= 0)."""
    b = b if isinstance(b, Column) else lit_long(b)
    return F.coalesce(F.try_add(a, b), lit_long(LONG_MAX))


def wrapping_add_le(a: Column, b: int, rhs: Column) -> Column:
    """``(a + b) <= rhs`` where the addition wraps around like a Java long (b >= 0).

    NULL ``rhs`` stands for "no watermark yet" and compares as false.
    """
    summed = F.try_add(a, lit_long(b))
    wrapped = a.cast("decimal(21,0)") + F.lit(Decimal(b - TWO_64)).cast("decimal(21,0)")
    return F.when(summed.isNull(), wrapped <= rhs.cast("decimal(21,0)")).otherwise(summed <= rhs)


def floor_div(a: Column, width: int) -> Column:
    """floor(a / width) in BIGINT arithmetic, exact for the whole int64 range (width > 0)."""
    w = lit_long(width)
    return F.call_function("div", a, w) - F.when(a % w < 0, lit_long(1)).otherwise(lit_long(0))


def ceil_div(a: Column, width: int) -> Column:
    """ceil(a / width) in BIGINT arithmetic, exact for the whole int64 range (width > 0)."""
    w = lit_long(width)
    return F.call_function("div", a, w) + F.when(a % w > 0, lit_long(1)).otherwise(lit_long(0))


def min_long_or(col: Column) -> Column:
    """NULL watermark ("none yet") rendered as Long.MIN_VALUE, as the reference prints it."""
    return F.coalesce(col, lit_long(LONG_MIN))
