"""Physical layout of the facts.

* S15: facts are written partitioned by sale month ``sold_ym`` (derived
  from the Julian date key), so a year-range report prunes whole folders.
* S16: a sale without a date lands in the NULL (Hive default) partition.
* S17: within each file rows are clustered by the hot foreign key, so
  parquet min/max statistics skip row groups on key lookups; with several
  foreign keys (``write_clustered``) rows follow a Z-order over all of them and
  every key column carries a Parquet bloom filter.
* S18: table statistics through ``ANALYZE TABLE`` on catalog tables.
* S19: a per-partition report (rows, key range, share in the unknown
  partition) replaces pre-creating future partitions; ``footer_counts`` answers
  it, and S06's row counts, from the Parquet footers alone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopstar.functions.dates import JULIAN_EPOCH_KEY, key_to_date
from shopstar.functions.numeric import pct
from shopstar.operators.ranking import unused
from shopstar.session import sibling
from shopstar.sources.paths import children, delete

PARTITION_COL = "sold_ym"
FACT_DATE_KEY = {"fact_store_sales": "ss_sold_date_sk", "fact_web_sales": "ws_sold_date_sk",
                 "fact_catalog_sales": "cs_sold_date_sk"}
FACT_CLUSTER_KEY = {"fact_store_sales": "ss_item_sk", "fact_web_sales": "ws_item_sk",
                    "fact_catalog_sales": "cs_item_sk"}
FACT_LOOKUP_KEYS = {"fact_store_sales": ["ss_item_sk", "ss_customer_sk"], "fact_web_sales": ["ws_item_sk", "ws_bill_customer_sk"],
                    "fact_catalog_sales": ["cs_item_sk", "cs_bill_customer_sk"]}
MAX_RECORDS_PER_FILE = 5_000_000
Z_BITS = 7  # a key's range is cut into 2^7 parts of about equal rows


def sold_ym(date_key_col: str):
    d = key_to_date(date_key_col)
    return (F.year(d) * 100 + F.month(d)).cast("int")


def write_fact(df: DataFrame, path: str, date_key: str, cluster_key: str | None = None,
               partitions: int | None = None, months: tuple[int, int] | None = None) -> None:
    """Write a fact partitioned by month, range-split and clustered within files.

    ``repartitionByRange`` on (month, cluster key, row hash) spreads one
    busy month over several tasks instead of hashing all of it into one;
    the deterministic row hash as last range key splits even a single hot
    (month, item) pair across tasks, and each task still gets a contiguous
    key range to sort.

    Without ``months`` the whole fact is replaced: months that the source no
    longer has are gone.  With ``months=(first, last)`` (yyyymm) the months of
    that range are replaced (S10): those in ``df`` by a partition overwrite,
    those that became empty are deleted after it; all others stay.
    """
    spark = df.sparkSession
    if cluster_key is None:
        cluster_key = next((c for c in df.columns if c.endswith("_item_sk")), date_key)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn(PARTITION_COL, sold_ym(date_key))
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
    out = (out.repartitionByRange(n, F.col(PARTITION_COL), F.col(cluster_key), row_hash)
           .sortWithinPartitions(PARTITION_COL, cluster_key))
    mode = "static" if months is None else "dynamic"
    (out.write.mode("overwrite").option("partitionOverwriteMode", mode)
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy(PARTITION_COL).parquet(path))
    if months is not None:
        held = {r[0] for r in df.select(sold_ym(date_key)).distinct().collect()}  # one row a month of the range
        for name in children(spark, path):
            ym = name.removeprefix(f"{PARTITION_COL}=")
            if ym.isdigit() and months[0] <= int(ym) <= months[1] and int(ym) not in held:
                delete(spark, f"{path.rstrip('/')}/{name}")


def z_value(df: DataFrame, keys: list[str], bits: int = Z_BITS, out: str = "z") -> DataFrame:
    """``df`` with the Z-order value of ``keys`` as the column ``out`` (null keys come first).

    A key's part is its place among approximate percentiles (one aggregate over the table, 2^bits numbers a key to the
    driver), so uneven keys still fill the parts evenly; the bits of all parts are interleaved, most significant first.
    """
    if bits * len(keys) > 62:
        raise ValueError("too many bits for a long")
    at = [i / 2 ** bits for i in range(1, 2 ** bits)]
    cuts = df.agg(*[F.percentile_approx(k, at).alias(f"c{i}") for i, k in enumerate(keys)]).first()
    parts = unused(df, *[f"part{i}" for i in range(len(keys))], out)[:len(keys)]
    rows = df.withColumns({p: F.lit(0) for p in parts})
    # binary search, compiled step by step: as many cuts as are not above the key; each step is a bit of the part
    for b in reversed(range(bits)):
        step = {}
        for i, (k, p) in enumerate(zip(keys, parts, strict=True)):
            if cuts[i] is not None:  # else no key at all
                at_p = F.element_at(F.array(*[F.lit(c) for c in cuts[i]]), F.col(p) + (1 << b))
                step[p] = F.col(p) + F.when(F.col(k) >= at_p, 1 << b).otherwise(0)
        rows = rows.withColumns(step)
    z = F.lit(0).cast("bigint")
    for i, p in enumerate(parts):
        for b in range(bits):
            z = z + F.shiftleft(F.shiftright(F.col(p), b).bitwiseAND(1).cast("bigint"), b * len(keys) + len(keys) - 1 - i)
    return rows.withColumn(out, z).drop(*parts)


def write_clustered(df: DataFrame, path: str, date_key: str, keys: list[str], partitions: int | None = None,
                    rows_per_file: int = MAX_RECORDS_PER_FILE, distinct: int = 1_000_000) -> None:
    """Write a fact by month, in Z-order of the foreign ``keys``, with a bloom filter on each of them.

    A lookup by any one of the keys skips files and row groups by their ranges, as a file holds a small part of every
    key's range; where the ranges do not tell, by the bloom filters, sized for ``distinct`` keys a row group (their
    columns are written without a dictionary, as Parquet keeps no filter beside one).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    [z] = unused(df, "z")
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
    out = z_value(df, keys, out=z).withColumn(PARTITION_COL, sold_ym(date_key))
    out = out.repartitionByRange(n, F.col(PARTITION_COL), F.col(z), row_hash).sortWithinPartitions(PARTITION_COL, z).drop(z)
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", rows_per_file)
    for k in keys:
        w = (w.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", str(distinct))
             .option(f"parquet.enable.dictionary#{k}", "false"))
    w.partitionBy(PARTITION_COL).parquet(path)


def footer_counts(spark: SparkSession, path: str, key: str, by_month: bool = False) -> DataFrame:
    """(rows, min_key, max_key) of a written table, by month if wanted, read from the Parquet footers.

    The counts and the key's range are pushed into the scan, which then reads no column.  Files of the undated partition
    hold no key, so their range is not asked for.  The scan's settings live in a session of their own.
    """
    own = sibling(spark, {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"})
    t = own.read.parquet(path)
    if not by_month:
        dated = t.where(F.col(PARTITION_COL).isNotNull()) if PARTITION_COL in t.columns else t
        counted, span = t.agg(F.count(F.lit(1)).alias("n")), dated.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))
        # the sum of no footer's count is null, though a count never is: the outer join admits the null
        one = own.range(1).join(counted, F.lit(True), "left").join(span, F.lit(True), "left")
        return one.select(F.coalesce("n", F.lit(0)).cast("bigint").alias("rows"), "min_key", "max_key")
    counts = t.groupBy(PARTITION_COL).agg(F.count(F.lit(1)).alias("rows"))
    ranges = t.where(F.col(PARTITION_COL).isNotNull()).groupBy(PARTITION_COL).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))
    ranges = ranges.withColumnRenamed(PARTITION_COL, "month")
    return counts.join(ranges, F.col(PARTITION_COL) == F.col("month"), "left").drop("month")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a whole table as it is laid out: a fact with its month column keeps its month folders."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "static")
    if PARTITION_COL in df.columns:
        w = w.partitionBy(PARTITION_COL)
    w.parquet(path)


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _julian(d: _dt.date) -> int:
    return (d - _dt.date(2000, 1, 1)).days + JULIAN_EPOCH_KEY


def restrict_years(df: DataFrame, date_key: str, years) -> DataFrame:
    """Keep sales dated in the year range; prunes month partitions when present.

    Equivalent to the calendar join's year filter, applied before any
    aggregation so less data reaches the exchange.
    """
    lo, hi = years
    cond = F.col(date_key).between(_julian(_dt.date(lo, 1, 1)), _julian(_dt.date(hi, 12, 31)))
    if PARTITION_COL in df.columns:
        cond = F.col(PARTITION_COL).between(lo * 100 + 1, hi * 100 + 12) & cond
    return df.filter(cond)


def join_calendar(fact: DataFrame, calendar: DataFrame, date_key: str) -> DataFrame:
    """Join a fact with (filtered) calendar days; on written marts by the month, too.

    The month is the fact's partition column, so a filter on the calendar (a quarter, holidays) reaches the scan as
    dynamic partition pruning: only the month folders that hold a day of the filtered calendar are read.  The calendar
    is broadcast: it has a row a day.
    """
    on = fact[date_key] == calendar["date_sk"]
    if PARTITION_COL in fact.columns and PARTITION_COL in calendar.columns:
        on = on & (fact[PARTITION_COL] == calendar[PARTITION_COL])
    joined = fact.join(F.broadcast(calendar), on)
    return joined.drop(calendar[PARTITION_COL]) if PARTITION_COL in calendar.columns else joined


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write ``df`` as the catalog table ``name`` below ``path``, bucketed and sorted by ``keys``; reads it back.

    Tables with the same keys and bucket count join on these keys without an exchange.  The rows are dealt by the keys
    first, so every bucket is one file.
    """
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def register_table(spark: SparkSession, name: str, path: str, partitioned: bool = False) -> None:
    """Expose a written folder as a catalog table (needed for ANALYZE)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")
    if partitioned:
        spark.sql(f"MSCK REPAIR TABLE {name}")


def analyze_table(spark: SparkSession, name: str) -> DataFrame:
    """Collect table and column statistics; returns the stats rows.

    With ``spark.sql.statistics.histogram.enabled`` columns get equi-height histograms, too.
    """
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter(F.col("col_name") == "Statistics")


def partition_report(fact: DataFrame, date_key: str) -> DataFrame:
    """Rows and date-key range per month partition, with each share of the total.

    The window runs over one row per month.
    """
    part = fact[PARTITION_COL] if PARTITION_COL in fact.columns else sold_ym(date_key)
    g = (fact.groupBy(part.alias(PARTITION_COL))
         .agg(F.count(F.lit(1)).alias("rows"), F.min(date_key).alias("min_date_sk"),
              F.max(date_key).alias("max_date_sk")))
    total = F.sum("rows").over(Window.partitionBy())
    return g.select(
        F.coalesce(F.col(PARTITION_COL).cast("string"), F.lit("__unknown__")).alias("partition"),
        "rows", "min_date_sk", "max_date_sk",
        pct(F.col("rows"), total).cast("double").alias("pct_of_rows"),
    ).orderBy("partition")
