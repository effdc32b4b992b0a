"""Row numbers, ranks and first rows of groups without a single-task sort.

A row's number is its place in its own range partition plus the counts of the
partitions before: only one row per partition and group meets in a window.  A
repeated or hot sort key is split by a salt, so no partition has to hold all
rows of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopstar.session import ensure_checkpoint_dir

# Rows that one window group of ``first_rows`` may expect.
GROUP_ROWS = 200_000


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of ``df`` has them (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def _join_keys(rows: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on equal or equally null ``names``; the result has the columns of ``rows`` and the others of ``other``."""
    fresh = dict(zip(names, unused(rows, *[f"__k{i}" for i in range(len(names))]), strict=True))
    side = other.select(*[F.col(f"`{c}`").alias(fresh.get(c, c)) for c in other.columns])
    same = F.lit(True)
    for c, k in fresh.items():
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`{k}`"))
    return rows.join(side, same).drop(*fresh.values())


def number_rows(df: DataFrame, order: list, by: list[str] = (), out: str = "row_number", total: str | None = None) -> DataFrame:
    """``df`` with a column ``out``: place of the row (from 0) among the rows of its ``by`` values in ``order``.

    ``total`` names a further column for the number of rows of the group.  Rows alike in ``order`` get consecutive
    numbers; which one is first is not defined.  Nulls sort as Spark's ascending order does (first); an empty table
    gives an empty table.  The sorted rows are checkpointed once, as another run could cut the ranges elsewhere.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = list(by)
    salt, part, place, first, n, before, all_rows = unused(df, "__salt", "__part", "__place", "__first", "__n", "__before", "__all")
    keys = [F.col(f"`{c}`") for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    salted = df.withColumn(salt, F.monotonically_increasing_id())
    rows = (salted.repartitionByRange(*keys, F.col(salt)).sortWithinPartitions(*keys, F.col(salt)).drop(salt)
            .withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id())).checkpoint()
    runs = rows.groupBy(part, *by).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(*by)  # one row per partition and group
    runs = runs.withColumn(before, F.coalesce(F.sum(n).over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn(all_rows, F.sum(n).over(w)).drop(n)
    joined = _join_keys(rows, runs, [part, *by])
    numbered = [(F.col(place) - F.col(first) + F.col(before)).alias(out)]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *numbered, *([F.col(all_rows).alias(total)] if total else []))


def rank_rows(df: DataFrame, order: list[tuple[str, bool]], by: list[str] = (), out: str = "rank") -> DataFrame:
    """``df`` with SQL's RANK() over (PARTITION BY ``by`` ORDER BY ``order``), every row, however large the groups.

    ``order``: (column, descending) pairs; nulls come first ascending and last descending.  Rows with the same sort
    values share the rank of their first row; ties may lie across partition borders.
    """
    by, names = list(by), [c for c, _ in order]
    number, least = unused(df, "__number", "__least")
    sort = [F.col(f"`{c}`").desc() if down else F.col(f"`{c}`").asc() for c, down in order]
    rows = number_rows(df, sort, by, out=number)
    firsts = rows.groupBy(*by, *names).agg((F.min(number) + 1).alias(least))
    joined = _join_keys(rows, firsts, [*by, *names])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.col(least).alias(out))


def first_rows(df: DataFrame, by: list[str], order: list, k: int, out: str = "rank", group_rows: int = GROUP_ROWS) -> DataFrame:
    """The first ``k`` rows of every ``by`` group in ``order``, numbered from 1 in ``out``.

    A tournament: rows are dealt by a hash into heats of about ``group_rows``, every heat keeps its first ``k``, and
    so on until a group's rows fit one heat.  ``order`` must not leave ties between different rows.
    """
    heat, = unused(df, "__heat")
    rows, count = df, df.count()
    everything = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    while count > group_rows:
        heats = -(-count // group_rows)
        w = Window.partitionBy(*by, heat).orderBy(*order)
        rows = rows.withColumn(heat, F.pmod(everything, F.lit(heats))).withColumn(out, F.row_number().over(w))
        rows = rows.where(F.col(out) <= k).drop(heat, out)
        if heats * k >= count:
            break
        count = heats * k
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)
