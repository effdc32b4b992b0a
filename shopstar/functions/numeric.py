"""Exact decimal helpers shared by every report.

The reference computes money in exact ``numeric``.  Spark keeps decimals
exact as long as no double sneaks in, so every constant here is a
``Decimal`` literal (``1e6`` would turn the column into a double), and
averages are written as ``sum / count`` because ``avg(decimal)`` rounds to
six places before the report rounds again.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(value: str | int) -> Column:
    """Exact decimal literal."""
    return F.lit(Decimal(str(value)))


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonzero(c: Column | str) -> Column:
    """``NULLIF(c, 0)``: divide guard (ANSI mode raises on division by zero)."""
    c = as_col(c)
    return F.when(c != 0, c)


def scaled(c: Column | str, unit: int, digits: int = 2) -> Column:
    """``ROUND(c / unit, digits)`` in exact decimal arithmetic."""
    return F.round(as_col(c) / dec(unit), digits)


def millions(c: Column | str) -> Column:
    return scaled(c, 1_000_000)


def pct(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    """``ROUND(100.0 * num / NULLIF(den, 0), digits)``."""
    return F.round(dec("100.0") * as_col(num) / nonzero(den), digits)


def ratio(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    """``ROUND(num / NULLIF(den, 0), digits)``."""
    return F.round(as_col(num) / nonzero(den), digits)


def exact_avg(total: Column | str, count: Column | str, digits: int = 2) -> Column:
    """``ROUND(AVG(x), digits)`` from a decimal sum and a non-null count."""
    return F.round(as_col(total) / nonzero(count), digits)


def to_double(c: Column | str) -> Column:
    """Final hand-off type of a rounded measure (exact decimal -> double)."""
    return as_col(c).cast("double")


def money(c: Column | str, precision: int = 12) -> Column:
    """Source double with two decimals -> exact ``DECIMAL(precision, 2)``."""
    return as_col(c).cast(f"decimal({precision},2)")
