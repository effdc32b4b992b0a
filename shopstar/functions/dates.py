"""Calendar helpers: Julian day keys and safe date construction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The warehouse keys days by Julian day number;
# 2451545 is 2000-01-01 (so 2001-01-01 is 2451911).
JULIAN_EPOCH_DATE = "2000-01-01"
JULIAN_EPOCH_KEY = 2451545


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def julian_key(d: Column | str) -> Column:
    """Date (or timestamp) -> integer Julian day key."""
    return (F.datediff(_c(d).cast("date"), F.lit(JULIAN_EPOCH_DATE).cast("date"))
            + F.lit(JULIAN_EPOCH_KEY)).cast("int")


def key_to_date(k: Column | str) -> Column:
    """Julian day key -> date (inverse of :func:`julian_key`)."""
    return F.date_add(F.lit(JULIAN_EPOCH_DATE).cast("date"), (_c(k) - F.lit(JULIAN_EPOCH_KEY)).cast("int"))


def safe_make_date(y: Column | str, m: Column | str, d: Column | str) -> Column:
    """``MAKE_DATE`` that yields NULL for an impossible date instead of raising."""
    text = F.format_string("%04d-%02d-%02d", _c(y), _c(m), _c(d))
    return F.try_to_date(text, "yyyy-MM-dd")


def days_between_keys(later: Column | str, earlier: Column | str) -> Column:
    """Day difference of two date keys, computed through the calendar dates."""
    return F.datediff(key_to_date(later), key_to_date(earlier))
