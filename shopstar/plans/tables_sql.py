"""Oracle SQL (DuckDB) for the registered mart tables and table-level reports."""

from __future__ import annotations

from shopstar.operators.marts import DIM_KEYS, FACT_NOT_NULL
from shopstar.plans.oracle import pct_c, with_marts
from shopstar.operators.staging import STAGING_RULES
from shopstar.plans.tables import DECIMAL_COLUMNS, MART_TABLES, REFERENCE, STAGED, STAGED_MONEY
from shopstar.sources.rawtables import columns, oracle_table

_YM = ("(year(DATE '2000-01-01' + (ss_sold_date_sk - 2451545)) * 100 "
       "+ month(DATE '2000-01-01' + (ss_sold_date_sk - 2451545)))")

def _mart_select(t: str) -> str:
    cols = DECIMAL_COLUMNS.get(t, [])
    if not cols:
        return f"SELECT * FROM {t}"
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)}) FROM {t}"


SQL = {f"m{i + 1:02d}_{t}": with_marts(_mart_select(t)) for i, t in enumerate(MART_TABLES)}
SQL["s06_mart_row_counts"] = with_marts("\nUNION ALL\n".join(
    f"SELECT 'marts' AS schema_name, '{t}' AS table_name, count(*) AS rows FROM {t}" for t in MART_TABLES))
SQL["s12_key_violations"] = with_marts("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST({k} AS BIGINT) AS key_value, count(*) AS rows FROM {t} "
    f"GROUP BY {k} HAVING count(*) > 1 OR {k} IS NULL" for t, k in DIM_KEYS.items()))
SQL["s13_fact_null_counts"] = with_marts("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_rows FROM {t}"
    for t, cols in FACT_NOT_NULL.items() for c in cols))
SQL["s19_store_partition_report"] = with_marts(f"""
SELECT COALESCE(CAST(ym AS VARCHAR), '__unknown__') AS partition, count(*) AS rows,
       min(ss_sold_date_sk) AS min_date_sk, max(ss_sold_date_sk) AS max_date_sk,
       {pct_c('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_rows
FROM (SELECT *, CAST({_YM} AS INTEGER) AS ym FROM fact_store_sales) f
GROUP BY ym ORDER BY partition""")


def _staged_select(t: str) -> str:
    cols = STAGED_MONEY[t]
    star = "*" if not cols else f"* REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)})"
    keys = " AND ".join(f"{k} IS NOT NULL" for k in STAGING_RULES[t].keys)
    return f"SELECT {star} FROM {t} WHERE {keys}"


SQL.update({key: with_marts(_staged_select(t)) for key, t in STAGED.items()})

# ---- T01-T17: the cleaning rules, spelled out per table; M01-M05: the mart columns of the cleaned rows ----
_TRIM = {
    "date_dim": "d_date_id d_day_name d_quarter_name", "time_dim": "t_time_id t_am_pm t_shift t_sub_shift t_meal_time",
    "customer": "c_customer_id c_salutation c_first_name c_last_name", "customer_address": "ca_address_id",
    "item": "i_item_id i_brand i_class i_category i_manufact i_size i_formulation i_color i_units i_container i_product_name",
}
_BLANK_NULL = {
    "customer": "c_birth_country c_login c_email_address",
    "customer_address": "ca_street_number ca_street_name ca_street_type ca_suite_number ca_city ca_county ca_state ca_zip ca_country "
                        "ca_location_type",
    "item": "i_item_desc",
}


def clean_rows(t: str) -> str:
    """The staged rows of a reference table (decimals as double)."""
    cols = []
    for c, _, kind in columns(t, "VARCHAR", "0"):
        e = c
        if c in _TRIM.get(t, "").split():
            e = f"trim({c})"
        elif c in _BLANK_NULL.get(t, "").split():
            e = f"CASE WHEN trim({c}) <> '' THEN trim({c}) END"
        elif kind.startswith("decimal"):
            e = f"CAST({c} AS DOUBLE)"
        cols.append(f"{e} AS {c}")
    if t == "reason":
        cols.append("trim(r_reason_desc) AS r_reason_desc_clean")
    key = columns(t, "VARCHAR", "0")[0][0]
    return f"SELECT {', '.join(cols)} FROM ({oracle_table(t)}) raw WHERE {key} IS NOT NULL"


SQL.update({f"{k}_derived": SQL[k] for k in list(SQL) if k[:3] in ("m01", "m02", "m03", "m04", "m05")})
SQL.update({f"t{i + 1:02d}_{t}": clean_rows(t) for i, t in enumerate(REFERENCE)})
SQL["m01_dim_date"] = f"""
SELECT d_date_sk AS date_sk, d_date AS full_date, d_year AS year, d_qoy AS quarter, d_moy AS month, d_dom AS day_of_month,
       d_dow AS day_of_week, d_day_name AS day_name, d_week_seq AS week_seq, d_month_seq AS month_seq, d_quarter_seq AS quarter_seq,
       d_holiday IS NOT DISTINCT FROM 'Y' AS is_holiday, d_weekend IS NOT DISTINCT FROM 'Y' AS is_weekend,
       d_current_year IS NOT DISTINCT FROM 'Y' AS is_current_year
FROM ({clean_rows("date_dim")}) t"""
SQL["m02_dim_customer"] = f"""
SELECT c_customer_sk AS customer_sk, c_customer_id AS customer_id, c_first_name AS first_name, c_last_name AS last_name,
       c_salutation AS salutation, c_email_address AS email, c_preferred_cust_flag AS preferred_flag, c_birth_year AS birth_year,
       c_birth_country AS birth_country, cd_gender AS gender, cd_marital_status AS marital_status,
       cd_education_status AS education_status, cd_purchase_estimate AS purchase_estimate, cd_credit_rating AS credit_rating,
       cd_dep_count AS dep_count, ca_city AS city, ca_state AS state, ca_zip AS zip, ca_country AS country,
       ca_gmt_offset AS gmt_offset, c_current_cdemo_sk AS cd_demo_sk, c_current_addr_sk AS ca_address_sk
FROM ({clean_rows("customer")}) c LEFT JOIN ({clean_rows("customer_demographics")}) d ON c_current_cdemo_sk = cd_demo_sk
LEFT JOIN ({clean_rows("customer_address")}) a ON c_current_addr_sk = ca_address_sk"""
SQL["m03_dim_item"] = f"""
SELECT i_item_sk AS item_sk, i_item_id AS item_id, i_product_name AS product_name, i_brand AS brand, i_brand_id AS brand_id,
       i_class AS "class", i_class_id AS class_id, i_category AS category, i_category_id AS category_id, i_manufact AS manufacturer,
       i_manufact_id AS manufacturer_id, i_size AS size, i_color AS color, i_units AS units, i_container AS container,
       i_current_price AS current_price, i_wholesale_cost AS wholesale_cost, i_rec_start_date AS valid_from, i_rec_end_date AS valid_to
FROM ({clean_rows("item")}) t"""
SQL["m04_dim_store"] = f"""
SELECT s_store_sk AS store_sk, s_store_id AS store_id, s_store_name AS store_name, s_number_employees AS employees,
       s_floor_space AS floor_space, s_hours AS hours, s_manager AS manager, s_market_id AS market_id, s_market_desc AS market_desc,
       s_city AS city, s_state AS state, s_zip AS zip, s_country AS country, s_gmt_offset AS gmt_offset,
       s_tax_precentage AS tax_rate, s_rec_start_date AS valid_from, s_rec_end_date AS valid_to
FROM ({clean_rows("store")}) t"""
SQL["m05_dim_promotion"] = f"""
SELECT p_promo_sk AS promo_sk, p_promo_id AS promo_id, p_promo_name AS promo_name, p_purpose AS purpose, p_cost AS cost,
       p_response_target AS response_target, p_channel_dmail AS channel_dmail, p_channel_email AS channel_email,
       p_channel_catalog AS channel_catalog, p_channel_tv AS channel_tv, p_channel_radio AS channel_radio,
       p_channel_press AS channel_press, p_channel_event AS channel_event, p_channel_demo AS channel_demo,
       p_discount_active AS discount_active
FROM ({clean_rows("promotion")}) t"""
