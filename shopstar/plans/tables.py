"""Registered table-level reports over the derived marts: the mart outputs
themselves (M01-M08), row counts (S06), key checks (S12, S13) and the
partition report (S19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstar.operators import marts as M
from shopstar.operators.layout import partition_report
from shopstar.operators.staging import stage
from shopstar.plans.examples import every_channel
from shopstar.sources.rawtables import raw_table

MART_TABLES = ["dim_date", "dim_customer", "dim_item", "dim_store", "dim_promotion",
               "fact_store_sales", "fact_web_sales", "fact_catalog_sales"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# Money columns leave the registered mart outputs as doubles, like every other
# measure the reports hand over (the tables themselves keep exact decimals).
MONEY = ["wholesale_cost", "list_price", "sales_price", "ext_discount_amt", "ext_sales_price",
         "ext_wholesale_cost", "ext_list_price", "ext_tax", "coupon_amt", "ext_ship_cost", "net_paid",
         "net_paid_inc_tax", "net_paid_inc_ship", "net_paid_inc_ship_tax", "net_profit"]
DECIMAL_COLUMNS = {
    "dim_customer": ["gmt_offset"],
    "dim_item": ["current_price", "wholesale_cost"],
    "dim_promotion": ["cost"],
    "fact_store_sales": [f"ss_{c}" for c in MONEY if "ship" not in c],
    "fact_web_sales": [f"ws_{c}" for c in MONEY],
    "fact_catalog_sales": [f"cs_{c}" for c in MONEY],
}


def mart_table(name: str):
    def run(m) -> DataFrame:
        df = getattr(m, name)
        money = set(DECIMAL_COLUMNS.get(name, []))
        return df.select(*[F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in df.columns])
    run.__name__ = name
    run.__doc__ = f"The {name} mart table (money as double)."
    return run


# Staging-shaped tables the derivation defines, with the T rule that applies to each.
STAGED = {"t18_store_sales": "store_sales", "t19_store_returns": "store_returns",
          "t20_web_sales": "web_sales", "t21_web_returns": "web_returns",
          "t22_catalog_sales": "catalog_sales", "t23_catalog_returns": "catalog_returns",
          "t24_inventory": "inventory"}
STAGED_MONEY = {
    "store_sales": [f"ss_{c}" for c in MONEY if "ship" not in c],
    "web_sales": [f"ws_{c}" for c in MONEY],
    "catalog_sales": [f"cs_{c}" for c in MONEY],
    "store_returns": ["sr_return_amt", "sr_net_loss"],
    "web_returns": ["wr_return_amt", "wr_net_loss"],
    "catalog_returns": ["cr_return_amount", "cr_net_loss"],
    "inventory": [],
}


def staged_table(name: str):
    def run(m) -> DataFrame:
        df = stage(name, getattr(m, name))
        money = set(STAGED_MONEY[name])
        return df.select(*[F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in df.columns])
    run.__name__ = name
    run.__doc__ = f"T rule for {name} applied to the derived {name} (money as double)."
    return run


# Reference tables in the order of their rules; raw rows are derived, then staged like loaded files.
REFERENCE = ["date_dim", "time_dim", "customer", "customer_demographics", "customer_address", "item", "store", "promotion",
             "household_demographics", "web_site", "web_page", "warehouse", "ship_mode", "reason", "income_band", "call_center",
             "catalog_page"]
BUILT = {"m01_dim_date": (M.build_dim_date, ["date_dim"]), "m02_dim_customer": (M.build_dim_customer, ["customer", "customer_demographics", "customer_address"]),
         "m03_dim_item": (M.build_dim_item, ["item"]), "m04_dim_store": (M.build_dim_store, ["store"]),
         "m05_dim_promotion": (M.build_dim_promotion, ["promotion"])}


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def staged_reference(name: str):
    def run(m) -> DataFrame:
        return _doubles(stage(name, raw_table(m.t, name)))
    run.__name__ = name
    run.__doc__ = f"T rule for {name} over its raw-shaped rows (decimals as double)."
    return run


def built_dimension(key: str):
    builder, inputs = BUILT[key]

    def run(m) -> DataFrame:
        return _doubles(builder(*[stage(t, raw_table(m.t, t)) for t in inputs]))
    run.__name__ = key
    run.__doc__ = f"{key}: the builder over staged rows (decimals as double)."
    return run


def mart_row_counts(m) -> DataFrame:
    """Rows per mart table, largest first; the three facts are counted in one pass over the lines."""
    count = F.count(F.lit(1)).alias("rows")
    dims = [getattr(m, t).agg(count).select(F.lit("marts").alias("schema_name"), F.lit(t).alias("table_name"), "rows")
            for t in M.DIM_KEYS]
    per = m.all_channel_lines().groupBy("channel").agg(count)
    facts = every_channel(per.sparkSession, per).fillna(0, ["rows"]).select(
        F.lit("marts").alias("schema_name"), F.format_string("fact_%s_sales", "channel").alias("table_name"), "rows")
    return _union([facts, *dims]).orderBy(F.col("rows").desc(), "table_name")


def key_violations(m) -> DataFrame:
    """Primary-key violations of the five dimensions (empty when every key holds)."""
    parts = [M.key_violations(getattr(m, t), k).select(F.lit(t).alias("table_name"),
                                                       F.col(k).cast("bigint").alias("key_value"), "rows")
             for t, k in M.DIM_KEYS.items()]
    return _union(parts)


def fact_null_counts(m) -> DataFrame:
    """NULL count of each NOT NULL fact column, all from one pass over the lines."""
    null = lambda c: F.count(F.when(F.col(c).isNull(), 1)).alias(c)
    per = m.all_channel_lines("order_number").groupBy("channel").agg(null("item_sk"), null("order_number"))
    g = every_channel(per.sparkSession, per).fillna(0, ["item_sk", "order_number"])
    prefix = F.element_at(F.create_map(*[F.lit(x) for ch, p in (("store", "ss"), ("web", "ws"), ("catalog", "cs")) for x in (ch, p)]), F.col("channel"))
    number = F.when(F.col("channel") == "store", "_ticket_number").otherwise("_order_number")
    cells = F.array(F.struct(F.concat(prefix, F.lit("_item_sk")).alias("column_name"), F.col("item_sk").alias("null_rows")),
                    F.struct(F.concat(prefix, number).alias("column_name"), F.col("order_number").alias("null_rows")))
    return g.select(F.format_string("fact_%s_sales", "channel").alias("table_name"), F.inline(cells))


def store_partition_report(m) -> DataFrame:
    """Month partitions of the store fact with rows, key range and share."""
    return partition_report(m.fact_store_sales, "ss_sold_date_sk")


def registry(on):
    out = {f"m{i + 1:02d}_{t}": on(mart_table(t)) for i, t in enumerate(MART_TABLES)}
    # what the reports read (derived dimensions) beside what the builders make of staged rows
    out.update({f"{k}_derived": out[k] for k in BUILT})
    out.update({k: on(built_dimension(k)) for k in BUILT})
    out.update({f"t{i + 1:02d}_{t}": on(staged_reference(t)) for i, t in enumerate(REFERENCE)})
    out.update({key: on(staged_table(t)) for key, t in STAGED.items()})
    out.update({
        "s06_mart_row_counts": on(mart_row_counts),
        "s12_key_violations": on(key_violations),
        "s13_fact_null_counts": on(fact_null_counts),
        "s19_store_partition_report": on(store_partition_report),
    })
    return out
