"""Text formatting of operational values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Human-readable size units and thresholds of the source
# database's size formatter.  A value stays in bytes below 10240; each
# later unit is used below 20479 half-units (i.e. until it would print
# 10240 of that unit); PB is the last unit.
SIZE_UNITS = ["kB", "MB", "GB", "TB", "PB"]
BYTES_LIMIT = 10 * 1024
HALF_UNIT_LIMIT = 20 * 1024 - 1


def size_pretty(c: Column | str) -> Column:
    """Bytes -> '123 bytes' / '10 kB' / ... (rounded half-units, 1024 steps).

    Integer division by powers of two is a right shift of the magnitude
    (truncation toward zero, as in the source), so every level is one
    shift of the byte count and the rounding to whole units one more.
    """
    b = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    mag = F.abs(b)
    sign = F.when(b < 0, F.lit(-1)).otherwise(F.lit(1))
    expr = F.when(mag < BYTES_LIMIT, F.format_string("%d bytes", b))
    for i, unit in enumerate(SIZE_UNITS):
        half_units = F.shiftright(mag, 9 + 10 * i)  # magnitude in half-units of this unit
        text = F.format_string(f"%d {unit}", sign * F.shiftright(half_units + 1, 1))
        if i == len(SIZE_UNITS) - 1:
            expr = expr.otherwise(text)
        else:
            expr = expr.when(half_units < HALF_UNIT_LIMIT, text)
    return expr
