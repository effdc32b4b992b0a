"""Loads of a fact that readers see whole or not at all.

A versioned fact is a folder with ``loads/<id>`` (month-partitioned files of
one load, never changed) and ``_versions/v=<n>``: a small table that says which
load holds which month.  A load writes its files first and its version last;
Spark's ``_SUCCESS`` file, the last thing a version's write leaves, switches
readers over.  A load that dies leaves the version before as the current one,
and a reader that has started keeps the files of its version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.operators.layout import PARTITION_COL, read_fact, sold_ym, write_fact
from shopstar.sources.paths import children, delete, exists

VERSIONS, LOADS = "_versions", "loads"


class VersionedFact:
    """One fact below ``root`` with published versions."""

    def __init__(self, spark: SparkSession, root: str, date_key: str):
        self.spark, self.root, self.date_key = spark, root.rstrip("/"), date_key

    def version(self) -> int:
        """Number of the current version, 0 before the first load."""
        folder = f"{self.root}/{VERSIONS}"
        names = children(self.spark, folder) if exists(self.spark, folder) else []
        done = [int(n[2:]) for n in names if n.startswith("v=") and exists(self.spark, f"{folder}/{n}/_SUCCESS")]
        return max(done, default=0)

    def months(self, version: int | None = None) -> list[tuple[str, int | None]]:
        """(load, month) of a version, the current one by default; one row a month."""
        n = self.version() if version is None else version
        if not n:
            return []
        rows = self.spark.read.parquet(f"{self.root}/{VERSIONS}/v={n}").select("load", "month").collect()
        return sorted(((r["load"], r["month"]) for r in rows), key=str)

    def publish(self, df: DataFrame, months: tuple[int, int] | None = None) -> int:
        """Load ``df`` as the whole fact, or as the months of a range (yyyymm); returns the new version's number.

        With a range, rows of other months are an error: a load replaces the range and nothing else.
        """
        load = uuid.uuid4().hex
        path = f"{self.root}/{LOADS}/{load}"
        write_fact(df, path, self.date_key)
        held = [r[0] for r in self.spark.read.parquet(path).select(PARTITION_COL).distinct().collect()]
        kept: list[tuple[str, int | None]] = []
        if months is not None:
            outside = [h for h in held if h is None or not months[0] <= h <= months[1]]
            if outside:
                delete(self.spark, path)
                raise ValueError(f"months {outside} are not in the range {months}")
            kept = [(old, m) for old, m in self.months() if m is None or not months[0] <= m <= months[1]]
        return self._switch([*kept, *[(load, m) for m in held]])

    def _switch(self, rows: list[tuple[str, int | None]]) -> int:
        n = self.version() + 1
        folder = f"{self.root}/{VERSIONS}/v={n}"  # what a dead load has left of it is replaced
        self.spark.createDataFrame(rows, "load string, month int").coalesce(1).write.mode("overwrite").parquet(folder)
        return n

    def read(self, version: int | None = None) -> DataFrame:
        """The fact as of a version; month filters prune the folders of every load."""
        by_load: dict[str, list[int | None]] = {}
        for load, month in self.months(version):
            by_load.setdefault(load, []).append(month)
        if not by_load:
            raise ValueError(f"nothing was loaded into {self.root}")
        out = None
        for load, held in by_load.items():
            month = F.col(PARTITION_COL)
            mine = month.isin([m for m in held if m is not None])
            part = read_fact(self.spark, f"{self.root}/{LOADS}/{load}").where(mine | month.isNull() if None in held else mine)
            out = part if out is None else out.unionByName(part)
        return out

    def clean(self) -> list[str]:
        """Remove the loads that the current version does not use (readers of older versions must be done)."""
        used = {load for load, _ in self.months()}
        folder = f"{self.root}/{LOADS}"
        old = [n for n in (children(self.spark, folder) if exists(self.spark, folder) else []) if n not in used]
        for n in old:
            delete(self.spark, f"{folder}/{n}")
        return old


def reload_months(fact: VersionedFact, source: DataFrame, months: tuple[int, int]) -> int:
    """Replace a month range by what the source has for it now; a month that became empty goes."""
    return fact.publish(source.where(sold_ym(fact.date_key).between(*months)), months)
