"""The full warehouse build from delimited TPC-DS-shaped source files.

``build_warehouse`` runs the three layers in order, each written once:

1. raw: every source file landed (one pass per file, rejects kept aside);
2. staging: the per-table cleaning rules, written as tables (S08);
3. marts: dimensions and date-partitioned facts built from staging, key
   checks first (S12, S13), plus the staging tables the reports read
   directly (returns, inventory, reference tables).

The result is read back as :class:`WrittenMarts`, on which every report
of ``shopstar.plans`` runs unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopstar.operators.marts import (SIDE_TABLES, MartFrames, WrittenMarts, assert_primary_key, build_marts,
                                      write_marts)
from shopstar.operators.staging import stage
from shopstar.sources import delimited as D
from shopstar.sources.paths import exists
from shopstar.sources.schemas import LOAD_ORDER


def build_warehouse(spark: SparkSession, src_dir: str, out_dir: str, tables=LOAD_ORDER) -> WrittenMarts:
    out = out_dir.rstrip("/")
    raw_dir, staging_dir, marts_dir = f"{out}/raw", f"{out}/staging", f"{out}/marts"
    landed = D.load_all(spark, src_dir, raw_dir, tables, mode="overwrite")
    staged: dict[str, DataFrame] = {}
    for t, path in landed.items():
        if path is None:
            continue
        stage(t, D.read_landed(spark, raw_dir, t)).write.mode("overwrite").parquet(f"{staging_dir}/{t}")
        staged[t] = spark.read.parquet(f"{staging_dir}/{t}")
    needed = {"date_dim", "customer", "customer_demographics", "customer_address", "item", "store", "promotion",
              "store_sales", "web_sales", "catalog_sales"}
    missing = needed - set(staged)
    if missing:
        raise ValueError(f"cannot build the marts without {sorted(missing)}")
    marts = build_marts(staged)
    # The two LEFT JOINs are on unique lookup keys, so every customer stays one row
    assert_primary_key(staged["customer_demographics"], "cd_demo_sk", "customer_demographics")
    assert_primary_key(staged["customer_address"], "ca_address_sk", "customer_address")
    marts.update({t: df for t, df in staged.items() if t in SIDE_TABLES})
    write_marts(MartFrames(marts), marts_dir)
    return WrittenMarts(spark, marts_dir)


def load_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """S06 over the raw layer of a built warehouse."""
    raw = f"{out_dir.rstrip('/')}/raw"
    present = [t for t in LOAD_ORDER if exists(spark, f"{raw}/{t}")]
    return D.load_report(spark, raw, present)


def reload_facts(spark: SparkSession, out_dir: str, months: tuple[int, int] | None = None) -> dict[str, int]:
    """Rebuild the three facts from the staging layer, for a month range or whole.

    With ``months=(first_yyyymm, last_yyyymm)`` only those month partitions
    are replaced (a month that became empty goes); the rest stay untouched.
    Without, each fact is replaced as a whole.
    Returns the rows written per fact.
    """
    from pyspark.sql import functions as F

    from shopstar.operators.layout import FACT_CLUSTER_KEY, FACT_DATE_KEY, sold_ym, write_fact
    from shopstar.operators.marts import FACT_NOT_NULL, assert_not_null, build_fact
    out = out_dir.rstrip("/")
    written = {}
    for staged_name, fact in (("store_sales", "fact_store_sales"), ("web_sales", "fact_web_sales"),
                              ("catalog_sales", "fact_catalog_sales")):
        df = build_fact(spark.read.parquet(f"{out}/staging/{staged_name}"), staged_name)
        if months is not None:
            df = df.filter(sold_ym(FACT_DATE_KEY[fact]).between(*months))
        assert_not_null(df, FACT_NOT_NULL[fact], fact)
        write_fact(df, f"{out}/marts/{fact}", FACT_DATE_KEY[fact], FACT_CLUSTER_KEY[fact], months=months)
        written[fact] = spark.read.parquet(f"{out}/marts/{fact}").filter(
            F.col("sold_ym").between(*months) if months else F.lit(True)).count()
    return written
