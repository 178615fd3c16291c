"""Money is DECIMAL(18,2), rounded half up wherever a charge is booked; ratios are doubles and null on a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(28,8)"


def cents(c: Column) -> Column:
    return F.round(c.cast(WIDE), 2).cast(MONEY)


def money(value) -> Column:
    return F.lit(str(value)).cast(MONEY)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def total(c: Column) -> Column:
    """Sum of money, 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)
