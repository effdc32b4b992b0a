"""Raw -> staging (T01-T24): one row per source row, same column names.

Each table's rule is data, not code: which columns are trimmed, which are
trimmed and blank-to-NULL, which keys must be present, and any extra
column.  The transform is one ``filter`` + ``select`` per table, so it is
a narrow, shuffle-free stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstar.sources.schemas import RAW_DDL


@dataclass(frozen=True)
class StagingRule:
    keys: tuple[str, ...]
    trim: tuple[str, ...] = ()
    trim_blank_to_null: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)  # new column -> (function name, source column)


# The cleaning rules of the staging layer, per table.
STAGING_RULES: dict[str, StagingRule] = {
    "date_dim": StagingRule(("d_date_sk",), trim=("d_date_id", "d_day_name", "d_quarter_name")),
    "time_dim": StagingRule(("t_time_sk",), trim=("t_time_id", "t_am_pm", "t_shift", "t_sub_shift", "t_meal_time")),
    "customer": StagingRule(("c_customer_sk",),
                            trim=("c_customer_id", "c_salutation", "c_first_name", "c_last_name"),
                            trim_blank_to_null=("c_birth_country", "c_login", "c_email_address")),
    "customer_demographics": StagingRule(("cd_demo_sk",)),
    "customer_address": StagingRule(("ca_address_sk",), trim=("ca_address_id",),
                                    trim_blank_to_null=("ca_street_number", "ca_street_name", "ca_street_type",
                                                        "ca_suite_number", "ca_city", "ca_county", "ca_state",
                                                        "ca_zip", "ca_country", "ca_location_type")),
    "item": StagingRule(("i_item_sk",),
                        trim=("i_item_id", "i_brand", "i_class", "i_category", "i_manufact", "i_size",
                              "i_formulation", "i_color", "i_units", "i_container", "i_product_name"),
                        trim_blank_to_null=("i_item_desc",)),
    "store": StagingRule(("s_store_sk",)),
    "promotion": StagingRule(("p_promo_sk",)),
    "household_demographics": StagingRule(("hd_demo_sk",)),
    "web_site": StagingRule(("web_site_sk",)),
    "web_page": StagingRule(("wp_web_page_sk",)),
    "warehouse": StagingRule(("w_warehouse_sk",)),
    "ship_mode": StagingRule(("sm_ship_mode_sk",)),
    "reason": StagingRule(("r_reason_sk",), extra={"r_reason_desc_clean": ("trim", "r_reason_desc")}),
    "income_band": StagingRule(("ib_income_band_sk",)),
    "call_center": StagingRule(("cc_call_center_sk",)),
    "catalog_page": StagingRule(("cp_catalog_page_sk",)),
    "store_sales": StagingRule(("ss_item_sk", "ss_ticket_number")),
    "store_returns": StagingRule(("sr_item_sk", "sr_ticket_number")),
    "web_sales": StagingRule(("ws_item_sk", "ws_order_number")),
    "web_returns": StagingRule(("wr_item_sk", "wr_order_number")),
    "catalog_sales": StagingRule(("cs_item_sk", "cs_order_number")),
    "catalog_returns": StagingRule(("cr_item_sk", "cr_order_number")),
    "inventory": StagingRule(("inv_date_sk", "inv_item_sk")),
}


def stage(table: str, raw: DataFrame) -> DataFrame:
    """Apply the table's staging rule to its raw DataFrame."""
    rule = STAGING_RULES[table]
    keep = F.lit(True)
    for k in rule.keys:
        keep = keep & F.col(k).isNotNull()
    cols = []
    for name in raw.columns:
        c = F.col(name)
        if name in rule.trim:
            c = F.trim(c)
        elif name in rule.trim_blank_to_null:
            c = F.nullif(F.trim(c), F.lit(""))
        cols.append(c.alias(name))
    for new, (fn, src) in rule.extra.items():
        if fn != "trim":
            raise ValueError(fn)
        cols.append(F.trim(F.col(src)).alias(new))
    return raw.filter(keep).select(*cols)
