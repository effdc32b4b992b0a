"""Staging -> marts (M01-M08), key checks (S12, S13) and the written warehouse.

Dimension builders are projections with renames (one has two LEFT JOINs);
fact builders select the mart columns.  Writes go through
:mod:`shopstar.operators.layout` (date partitions, clustering).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.operators.layout import (
    FACT_CLUSTER_KEY,
    FACT_DATE_KEY,
    PARTITION_COL,
    analyze_table,
    read_fact,
    register_table,
    restrict_years,
    sold_ym,
    write_fact,
)
from shopstar.session import sibling
from shopstar.sources.paths import delete, exists

# Mart column names and their staging sources.
DIM_DATE_MAP = [("d_date_sk", "date_sk"), ("d_date", "full_date"), ("d_year", "year"), ("d_qoy", "quarter"),
                ("d_moy", "month"), ("d_dom", "day_of_month"), ("d_dow", "day_of_week"),
                ("d_day_name", "day_name"), ("d_week_seq", "week_seq"), ("d_month_seq", "month_seq"),
                ("d_quarter_seq", "quarter_seq")]
DIM_DATE_FLAGS = [("d_holiday", "is_holiday"), ("d_weekend", "is_weekend"), ("d_current_year", "is_current_year")]
DIM_CUSTOMER_MAP = [("c.c_customer_sk", "customer_sk"), ("c.c_customer_id", "customer_id"),
                    ("c.c_first_name", "first_name"), ("c.c_last_name", "last_name"),
                    ("c.c_salutation", "salutation"), ("c.c_email_address", "email"),
                    ("c.c_preferred_cust_flag", "preferred_flag"), ("c.c_birth_year", "birth_year"),
                    ("c.c_birth_country", "birth_country"), ("cd.cd_gender", "gender"),
                    ("cd.cd_marital_status", "marital_status"), ("cd.cd_education_status", "education_status"),
                    ("cd.cd_purchase_estimate", "purchase_estimate"), ("cd.cd_credit_rating", "credit_rating"),
                    ("cd.cd_dep_count", "dep_count"), ("ca.ca_city", "city"), ("ca.ca_state", "state"),
                    ("ca.ca_zip", "zip"), ("ca.ca_country", "country"), ("ca.ca_gmt_offset", "gmt_offset"),
                    ("c.c_current_cdemo_sk", "cd_demo_sk"), ("c.c_current_addr_sk", "ca_address_sk")]
DIM_ITEM_MAP = [("i_item_sk", "item_sk"), ("i_item_id", "item_id"), ("i_product_name", "product_name"),
                ("i_brand", "brand"), ("i_brand_id", "brand_id"), ("i_class", "class"), ("i_class_id", "class_id"),
                ("i_category", "category"), ("i_category_id", "category_id"), ("i_manufact", "manufacturer"),
                ("i_manufact_id", "manufacturer_id"), ("i_size", "size"), ("i_color", "color"),
                ("i_units", "units"), ("i_container", "container"), ("i_current_price", "current_price"),
                ("i_wholesale_cost", "wholesale_cost"), ("i_rec_start_date", "valid_from"),
                ("i_rec_end_date", "valid_to")]
DIM_STORE_MAP = [("s_store_sk", "store_sk"), ("s_store_id", "store_id"), ("s_store_name", "store_name"),
                 ("s_number_employees", "employees"), ("s_floor_space", "floor_space"), ("s_hours", "hours"),
                 ("s_manager", "manager"), ("s_market_id", "market_id"), ("s_market_desc", "market_desc"),
                 ("s_city", "city"), ("s_state", "state"), ("s_zip", "zip"), ("s_country", "country"),
                 ("s_gmt_offset", "gmt_offset"), ("s_tax_precentage", "tax_rate"),
                 ("s_rec_start_date", "valid_from"), ("s_rec_end_date", "valid_to")]
DIM_PROMOTION_MAP = [("p_promo_sk", "promo_sk"), ("p_promo_id", "promo_id"), ("p_promo_name", "promo_name"),
                     ("p_purpose", "purpose"), ("p_cost", "cost"), ("p_response_target", "response_target"),
                     ("p_channel_dmail", "channel_dmail"), ("p_channel_email", "channel_email"),
                     ("p_channel_catalog", "channel_catalog"), ("p_channel_tv", "channel_tv"),
                     ("p_channel_radio", "channel_radio"), ("p_channel_press", "channel_press"),
                     ("p_channel_event", "channel_event"), ("p_channel_demo", "channel_demo"),
                     ("p_discount_active", "discount_active")]
# The mart columns of each fact, in order.
FACT_COLUMNS = {
    "store_sales": [
        "ss_sold_date_sk",
        "ss_sold_time_sk",
        "ss_item_sk",
        "ss_customer_sk",
        "ss_store_sk",
        "ss_promo_sk",
        "ss_ticket_number",
        "ss_quantity",
        "ss_wholesale_cost",
        "ss_list_price",
        "ss_sales_price",
        "ss_ext_discount_amt",
        "ss_ext_sales_price",
        "ss_ext_wholesale_cost",
        "ss_ext_list_price",
        "ss_ext_tax",
        "ss_coupon_amt",
        "ss_net_paid",
        "ss_net_paid_inc_tax",
        "ss_net_profit",
    ],
    "web_sales": [
        "ws_sold_date_sk",
        "ws_sold_time_sk",
        "ws_item_sk",
        "ws_bill_customer_sk",
        "ws_ship_customer_sk",
        "ws_web_page_sk",
        "ws_web_site_sk",
        "ws_promo_sk",
        "ws_order_number",
        "ws_quantity",
        "ws_wholesale_cost",
        "ws_list_price",
        "ws_sales_price",
        "ws_ext_discount_amt",
        "ws_ext_sales_price",
        "ws_ext_wholesale_cost",
        "ws_ext_list_price",
        "ws_ext_tax",
        "ws_coupon_amt",
        "ws_ext_ship_cost",
        "ws_net_paid",
        "ws_net_paid_inc_tax",
        "ws_net_paid_inc_ship",
        "ws_net_paid_inc_ship_tax",
        "ws_net_profit",
    ],
    "catalog_sales": [
        "cs_sold_date_sk",
        "cs_sold_time_sk",
        "cs_bill_customer_sk",
        "cs_ship_customer_sk",
        "cs_call_center_sk",
        "cs_catalog_page_sk",
        "cs_item_sk",
        "cs_promo_sk",
        "cs_order_number",
        "cs_quantity",
        "cs_wholesale_cost",
        "cs_list_price",
        "cs_sales_price",
        "cs_ext_discount_amt",
        "cs_ext_sales_price",
        "cs_ext_wholesale_cost",
        "cs_ext_list_price",
        "cs_ext_tax",
        "cs_coupon_amt",
        "cs_ext_ship_cost",
        "cs_net_paid",
        "cs_net_paid_inc_tax",
        "cs_net_paid_inc_ship",
        "cs_net_paid_inc_ship_tax",
        "cs_net_profit",
    ],
}
FACT_NOT_NULL = {
    "fact_store_sales": ["ss_item_sk", "ss_ticket_number"],
    "fact_web_sales": ["ws_item_sk", "ws_order_number"],
    "fact_catalog_sales": ["cs_item_sk", "cs_order_number"],
}
DIM_KEYS = {"dim_date": "date_sk", "dim_customer": "customer_sk", "dim_item": "item_sk",
            "dim_store": "store_sk", "dim_promotion": "promo_sk"}


def _rename(df: DataFrame, mapping) -> DataFrame:
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping])


def build_dim_date(date_dim: DataFrame) -> DataFrame:
    """Rename 11 calendar columns; 'Y' flags become booleans (NULL -> false)."""
    flags = [F.coalesce(F.col(src) == "Y", F.lit(False)).alias(dst) for src, dst in DIM_DATE_FLAGS]
    return date_dim.select(*[F.col(s).alias(d) for s, d in DIM_DATE_MAP], *flags)


def build_dim_customer(customer: DataFrame, demographics: DataFrame, address: DataFrame) -> DataFrame:
    """Customer LEFT JOIN demographics LEFT JOIN address (both lookups keyed uniquely)."""
    j = (customer.alias("c")
         .join(demographics.alias("cd"), F.col("c.c_current_cdemo_sk") == F.col("cd.cd_demo_sk"), "left")
         .join(address.alias("ca"), F.col("c.c_current_addr_sk") == F.col("ca.ca_address_sk"), "left"))
    return _rename(j, DIM_CUSTOMER_MAP)


def build_dim_item(item: DataFrame) -> DataFrame:
    """M03."""
    return _rename(item, DIM_ITEM_MAP)


def build_dim_store(store: DataFrame) -> DataFrame:
    """M04."""
    return _rename(store, DIM_STORE_MAP)


def build_dim_promotion(promotion: DataFrame) -> DataFrame:
    """M05."""
    return _rename(promotion, DIM_PROMOTION_MAP)


def build_fact(staging_sales: DataFrame, table: str) -> DataFrame:
    """The declared mart columns of a staging sales table, in order and with their kind of type.

    Keys and quantities stay whole numbers (a wider one is kept, so keys may outgrow the source's), money is
    decimal with two places; a staging column that is not declared never reaches the mart.
    """
    have = dict(staging_sales.dtypes)
    out = []
    for c in FACT_COLUMNS[table]:
        kind = have[c]
        whole = c.endswith(("_sk", "_number", "_quantity"))
        if whole:
            out.append(F.col(c) if kind in ("int", "bigint") else F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c) if kind.startswith("decimal") and kind.endswith(",2)") else F.col(c).cast("decimal(12,2)").alias(c))
    return staging_sales.select(*out)


# --------------------------------------------------------------------- checks
def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Key values that are NULL or occur more than once (empty = key holds)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
            .filter((F.col("rows") > 1) | F.col(key).isNull()))


def null_violations(df: DataFrame, cols) -> DataFrame:
    """One row with the NULL count of each NOT NULL column."""
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])


class ConstraintError(ValueError):
    pass


def assert_primary_key(df: DataFrame, key: str, name: str = "") -> None:
    bad = key_violations(df, key).limit(5).collect()
    if bad:
        raise ConstraintError(f"primary key {name}.{key} violated, e.g. {bad}")


def assert_not_null(df: DataFrame, cols, name: str = "") -> None:
    row = null_violations(df, cols).first()
    bad = {c: row[c] for c in cols if row[c]}
    if bad:
        raise ConstraintError(f"NOT NULL violated in {name}: {bad}")


def build_marts(staging: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All eight mart tables from staging DataFrames (lazy)."""
    return {
        "dim_date": build_dim_date(staging["date_dim"]),
        "dim_customer": build_dim_customer(staging["customer"], staging["customer_demographics"],
                                           staging["customer_address"]),
        "dim_item": build_dim_item(staging["item"]),
        "dim_store": build_dim_store(staging["store"]),
        "dim_promotion": build_dim_promotion(staging["promotion"]),
        "fact_store_sales": build_fact(staging["store_sales"], "store_sales"),
        "fact_web_sales": build_fact(staging["web_sales"], "web_sales"),
        "fact_catalog_sales": build_fact(staging["catalog_sales"], "catalog_sales"),
    }


# ------------------------------------------------------------ written marts
FACT_TABLES = ("fact_store_sales", "fact_web_sales", "fact_catalog_sales")
SIDE_TABLES = ("store_sales", "web_sales", "catalog_sales", "store_returns", "web_returns", "catalog_returns", "inventory", "warehouse",
               "reason", "time_dim", "web_page", "catalog_page", "ship_mode", "call_center",
               "household_demographics", "income_band", "run_log", "metrics", "date_dim", "customer", "customer_demographics",
               "customer_address", "item", "store", "promotion")


@contextmanager
def staged_lines(marts, folder: str):
    """The marts with their sale lines joined once, into a folder that goes when the facts are written; others as they are."""
    if not hasattr(marts, "stage_lines"):
        yield marts
        return
    scratch = f"{folder.rstrip('/')}/_staged_lines"
    try:
        yield marts.stage_lines(scratch)
    finally:
        if exists(marts.spark, scratch):
            delete(marts.spark, scratch)


def at_once(run, names, concurrency: int = 4) -> list:
    """Runs independent jobs from a small driver thread pool: they share the executors instead of queuing one after another."""
    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        return list(pool.map(run, names))


def write_marts(marts, out_dir: str, check_keys: bool = True, concurrency: int = 4) -> str:
    """Write dims (overwrite), facts (date-partitioned overwrite) and side tables.

    Keys are checked before anything is replaced (S12, S13), as the source
    adds its primary keys right after building each dimension.  The tables
    are independent, so their jobs are submitted from a small driver thread
    pool and share the executors instead of queuing one after another.
    """
    out = out_dir.rstrip("/")
    scratch = f"{out}/_staged_lines" if hasattr(marts, "stage_lines") else None
    if scratch:
        marts = marts.stage_lines(scratch)

    def check_dim(name):
        assert_primary_key(getattr(marts, name), DIM_KEYS[name], name)

    def check_fact(name):
        assert_not_null(getattr(marts, name), FACT_NOT_NULL[name], name)

    def write_plain(name):
        getattr(marts, name).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/{name}")

    def write_one_fact(name):
        write_fact(getattr(marts, name), f"{out}/{name}", FACT_DATE_KEY[name], FACT_CLUSTER_KEY[name])

    side = [n for n in SIDE_TABLES if hasattr(marts, n)]
    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        if check_keys:  # all checks pass before any table is replaced
            list(pool.map(check_dim, DIM_KEYS))
            list(pool.map(check_fact, FACT_TABLES))
        list(pool.map(write_one_fact, FACT_TABLES))
        list(pool.map(write_plain, [*DIM_KEYS, *side]))
    if scratch:
        delete(marts.spark, scratch)
    return out


class _ChannelUnion:
    """``all_channel_lines`` for marts held as three separate fact tables."""

    def sales_in_years(self, fact: str, years) -> DataFrame:
        """A sales fact cut to a year range (month folders are pruned where there are any)."""
        return restrict_years(getattr(self, fact), FACT_DATE_KEY[fact], years)

    def all_channel_lines(self, *measures: str, years=None) -> DataFrame:
        """The three facts as one frame (channel, item, sold date, measures), each fact pruned first."""
        parts = []
        for ch, t, p in (("store", "fact_store_sales", "ss"), ("web", "fact_web_sales", "ws"),
                         ("catalog", "fact_catalog_sales", "cs")):
            f = getattr(self, t)
            if years is not None:
                f = restrict_years(f, f"{p}_sold_date_sk", years)
            parts.append(f.select(F.lit(ch).alias("channel"), F.col(f"{p}_item_sk").alias("item_sk"),
                                  F.col(f"{p}_sold_date_sk").alias("sold_date_sk"),
                                  *[self._measure(p, m).alias(m) for m in measures]))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @staticmethod
    def _measure(p: str, measure: str):
        if p == "ss" and measure == "order_number":
            return F.col("ss_ticket_number")
        if p == "ss" and measure == "ext_ship_cost":  # nothing is shipped from a store
            return F.lit(0).cast("decimal(12,2)")
        return F.col(f"{p}_{measure}")

    def all_returns(self) -> DataFrame:
        """The three return tables as one frame (channel, order number, item, net loss)."""
        parts = [getattr(self, f"{ch}_returns").select(F.lit(ch).alias("channel"), F.col(f"{p}_{num}").alias("order_number"),
                                                       F.col(f"{p}_item_sk").alias("item_sk"), F.col(f"{p}_net_loss").alias("net_loss"))
                 for ch, p, num in (("store", "sr", "ticket_number"), ("web", "wr", "order_number"), ("catalog", "cr", "order_number"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @property
    def inventory_latest(self) -> DataFrame:
        """Inventory positions of the last snapshot date."""
        return self.inventory.where(F.col("inv_date_sk") == self.inventory.select(F.max("inv_date_sk")).scalar())


class MartFrames(_ChannelUnion):
    """Marts given as named DataFrames (e.g. freshly built, or hand-made in tests)."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.__dict__.update(tables)


class WrittenMarts(_ChannelUnion):
    """Marts read back from a written warehouse folder (same interface as DerivedMarts)."""

    def __init__(self, spark: SparkSession, marts_dir: str, log_path: str | None = None):
        """``log_path``: a run log that jobs append to; the run-log reports then read it."""
        self.spark = spark
        self.dir = marts_dir.rstrip("/")
        if log_path:
            self.run_log = spark.read.parquet(log_path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in FACT_TABLES:
            df = read_fact(self.spark, f"{self.dir}/{name}")
        elif name in DIM_KEYS or name in SIDE_TABLES:
            df = self._read(name)
            if name == "dim_date" and PARTITION_COL not in df.columns:  # the facts' month folders join on it
                df = df.withColumn(PARTITION_COL, sold_ym("date_sk"))
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    @cached_property
    def exists(self) -> bool:
        return exists(self.spark, f"{self.dir}/dim_date")


def register_views(spark: SparkSession, marts, names=None) -> list[str]:
    """Expose mart tables as temporary views so analysts can query them in Spark SQL."""
    done = []
    for name in names or (*DIM_KEYS, *FACT_TABLES, *SIDE_TABLES):
        absent = not exists(spark, f"{marts.dir}/{name}") if isinstance(marts, WrittenMarts) else not hasattr(marts, name)
        if absent:  # not part of this warehouse; any other trouble is an error
            continue
        getattr(marts, name).createOrReplaceTempView(name)
        done.append(name)
    return done


def analyze_marts(spark: SparkSession, marts_dir: str, database: str = "marts", tables=None) -> DataFrame:
    """Register the written marts in the catalog and collect table/column statistics with histograms.

    ``tables``: the eight marts by default; side tables can be named, too; those not there are skipped.  Returns one row per table with the statistics line
    the catalog keeps (size in bytes and row count); :class:`CatalogMarts` plans with them.
    """
    out = marts_dir.rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    own = sibling(spark, {"spark.sql.statistics.histogram.enabled": "true"})
    rows = []
    for name in tables or (*DIM_KEYS, *FACT_TABLES):
        if not exists(spark, f"{out}/{name}"):
            continue
        table = f"{database}.{name}"
        register_table(own, table, f"{out}/{name}", partitioned=name in FACT_TABLES)
        stats = analyze_table(own, table).first()
        rows.append((name, stats.data_type if stats else None))
    return spark.createDataFrame(rows, "table_name string, statistics string")


class CatalogMarts(_ChannelUnion):
    """Marts read through the catalog after :func:`analyze_marts`: joins are ordered by the statistics.

    Cost-based planning is set in a session of its own; the reports take these marts like any others.
    """

    def __init__(self, spark: SparkSession, database: str = "marts"):
        self.spark = sibling(spark, {f"spark.sql.cbo.{key}": "true" for key in ("enabled", "joinReorder.enabled", "planStats.enabled")})
        self.database = database

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not self.spark.catalog.tableExists(f"{self.database}.{name}"):
            raise AttributeError(name)
        df = self.spark.table(f"{self.database}.{name}")
        self.__dict__[name] = df
        return df
