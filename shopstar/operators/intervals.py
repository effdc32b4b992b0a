"""Points in validity intervals, without a join that compares all pairs.

Intervals are split over bins of the point's axis, points and pieces meet on
the bin (and on equal keys, if there are any), and the exact test follows.  A
point lies in one bin, so a pair is found once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containment_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: list[str] = (),
                     width: int = 64) -> DataFrame:
    """Every pair of a point and an interval [``start``, ``end``] that holds it; whole-number axis, e.g. date keys.

    A null bound leaves the interval open on that side; a null point is in none; an interval that ends before it starts
    holds nothing.  ``by``: columns of both sides that must be equal, too.  ``width``: the length of a bin.  Open
    intervals are cut to the points' range, so an interval has as many pieces as the range has bins, at most.
    """
    lo, hi = points.agg(F.min(point), F.max(point)).first()
    bin_name = "__bin"
    while bin_name in {*points.columns, *intervals.columns}:
        bin_name += "_"
    lo, hi = (0, -1) if lo is None else (lo, hi)
    first, last = F.greatest(F.coalesce(F.col(start), F.lit(lo)), F.lit(lo)), F.least(F.coalesce(F.col(end), F.lit(hi)), F.lit(hi))
    bins = F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))
    pieces = intervals.where(first <= last).withColumn(bin_name, bins)
    binned = points.where(F.col(point).isNotNull()).withColumn(bin_name, F.floor(F.col(point) / width))
    held = (F.col(start).isNull() | (F.col(point) >= F.col(start))) & (F.col(end).isNull() | (F.col(point) <= F.col(end)))
    return binned.join(pieces, [*by, bin_name]).where(held).drop(bin_name)
