"""Raw-shaped reference tables derived from the driver's tables.

The driver's data has no files of the source layout, so each of the 17 raw
reference tables is derived by a fixed rule per column, blank and padded text
included, and then goes through the same staging rules and builders as loaded
files.  A rule is an expression that Spark and DuckDB read alike, so the oracle
starts from the same rows; what staging and the builders do to them is stated
separately on either side.

Fixed values: the rules below.  ``k`` is the key of the base row; columns that
are not listed are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstar.sources.schemas import raw_schema

_ZIP = "lpad(cast(k % 100000 as {text}), 5, '0')"

# base rows: SELECT that both engines run, giving k and what the rules name
BASES = {
    "customer": "SELECT c_custkey AS k, c_name, c_mktsegment, n_name, r_name FROM customer "
                "LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "item": "SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    "supplier": "SELECT s_suppkey AS k, s_name, n_name, r_name, n_regionkey FROM supplier "
                "LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "priority": "SELECT cast(regexp_extract(o_orderpriority, '^([0-9]+)', 1) as int) AS k, "
                "min(regexp_extract(o_orderpriority, '^[0-9]+-(.*)$', 1)) AS p_name FROM orders "
                "WHERE regexp_extract(o_orderpriority, '^([0-9]+)', 1) NOT IN ('', '5') GROUP BY 1",
    "nation": "SELECT cast(n_nationkey + 1 as bigint) AS k, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "line": "SELECT DISTINCT cast(l_linenumber as bigint) AS k FROM lineitem",
    "twenty": "SELECT DISTINCT c_custkey % 20 + 1 AS k FROM customer",
    "day": "SELECT DISTINCT cast(o_orderdate as date) AS d FROM orders",
    "event_second": "SELECT DISTINCT cast(event_id * 7919 % 86400 as bigint) AS k FROM events",
}

_PAD = "concat({0}, '   ')"  # CHAR values arrive blank-padded

# table -> (base, {column: expression})
RULES: dict[str, tuple[str, dict[str, str]]] = {
    "date_dim": ("day", {
        "d_date_sk": "datediff_2000 + 2451545", "d_date_id": "concat('D', cast(datediff_2000 as {text}), '  ')", "d_date": "d",
        "d_month_seq": "(year(d) - 1900) * 12 + month(d) - 1", "d_week_seq": "cast(floor((datediff_2000 + 36524) / 7) as int) + 1",
        "d_quarter_seq": "(year(d) - 1900) * 4 + quarter(d) - 1", "d_year": "year(d)", "d_dow": "(datediff_2000 + 36524 + 6) % 7",
        "d_moy": "month(d)", "d_dom": "day(d)", "d_qoy": "quarter(d)",
        "d_day_name": "concat(case (datediff_2000 + 36524 + 6) % 7 when 0 then 'Sunday' when 6 then 'Saturday' else 'Weekday' end, '  ')",
        "d_quarter_name": "concat(cast(year(d) as {text}), 'Q', cast(quarter(d) as {text}))",
        "d_holiday": "case when month(d) = 12 and day(d) = 25 then 'Y' when month(d) = 6 then null else 'N' end",
        "d_weekend": "case when (datediff_2000 + 36524 + 6) % 7 in (0, 6) then 'Y' else 'N' end",
        "d_current_year": "case when year(d) = 1998 then 'Y' else 'N' end",
        "d_same_day_ly": "datediff_2000 + 2451545 - 365", "d_same_day_lq": "datediff_2000 + 2451545 - 91"}),
    "time_dim": ("event_second", {
        "t_time_sk": "k", "t_time_id": "concat('T', cast(k as {text}), ' ')", "t_time": "k", "t_hour": "cast(floor(k / 3600) as int)",
        "t_minute": "cast(floor(k / 60) as int) % 60", "t_second": "k % 60", "t_am_pm": "case when k < 43200 then 'AM' else 'PM' end",
        "t_shift": "case when k < 28800 then 'third  ' when k < 57600 then ' first' else 'second ' end",
        "t_sub_shift": "case when k < 21600 then 'night ' else 'day ' end", "t_meal_time": "case when k % 3 = 0 then 'lunch   ' end"}),
    "customer": ("customer", {
        "c_customer_sk": "case when k % 101 <> 0 then k end", "c_customer_id": _PAD.format("c_name"), "c_current_cdemo_sk": "k % 40 + 1",
        "c_current_hdemo_sk": "k % 20 + 1", "c_current_addr_sk": "k", "c_salutation": "case when k % 2 = 0 then 'Ms.  ' else ' Mr.' end",
        "c_first_name": "concat(' ', 'First', cast(k % 50 as {text}))", "c_last_name": "concat('Last', cast(k % 70 as {text}), '  ')",
        "c_preferred_cust_flag": "case when k % 3 = 0 then 'Y' when k % 3 = 1 then 'N' end", "c_birth_day": "k % 31 + 1",
        "c_birth_month": "k % 12 + 1", "c_birth_year": "1930 + k % 60", "c_birth_country": "case when k % 4 = 0 then '   ' else concat(r_name, ' ') end",
        "c_login": "case when k % 5 = 0 then '' else concat('u', cast(k as {text})) end",
        "c_email_address": "case when k % 6 = 0 then ' ' else concat(' ', 'c', cast(k as {text}), '@example.org') end"}),
    "customer_demographics": ("twenty", {
        "cd_demo_sk": "k", "cd_gender": "case when k % 2 = 0 then 'F' else 'M' end", "cd_marital_status": "case when k % 3 = 0 then 'S' else 'M' end",
        "cd_education_status": "case when k % 4 = 0 then 'Primary' when k % 4 = 1 then 'Secondary' else 'College' end",
        "cd_purchase_estimate": "k * 500", "cd_credit_rating": "case when k % 2 = 0 then 'Good' else 'Low Risk' end",
        "cd_dep_count": "k % 7", "cd_dep_employed_count": "k % 3", "cd_dep_college_count": "k % 2"}),
    "customer_address": ("customer", {
        "ca_address_sk": "k", "ca_address_id": "concat('A', cast(k as {text}), '  ')", "ca_street_number": "case when k % 7 = 0 then '  ' else cast(k % 900 as {text}) end",
        "ca_street_name": "concat(' ', c_mktsegment, ' ')", "ca_street_type": "case when k % 3 = 0 then '' else 'Lane ' end",
        "ca_suite_number": "concat('Suite ', cast(k % 90 as {text}))", "ca_city": "case when k % 8 = 0 then '    ' else concat(n_name, '  ') end",
        "ca_county": "concat(n_name, ' County ')", "ca_state": "case when k % 9 = 0 then ' ' else substr(n_name, 1, 2) end", "ca_zip": _ZIP,
        "ca_country": "concat(' ', r_name)", "ca_gmt_offset": "cast(-(k % 12) as decimal(5,2))", "ca_location_type": "case when k % 2 = 0 then 'condo ' else '  ' end"}),
    "item": ("item", {
        "i_item_sk": "case when k % 97 <> 0 then k end", "i_item_id": "concat('ITEM', cast(k as {text}), '  ')", "i_rec_start_date": "cast('1995-01-01' as date)",
        "i_rec_end_date": "case when k % 10 = 0 then cast('2000-12-31' as date) end", "i_item_desc": "case when k % 11 = 0 then '  ' else concat(' ', p_name, '. ') end",
        "i_current_price": "cast(p_retailprice as decimal(7,2))", "i_wholesale_cost": "cast(k % 90 as decimal(7,2))", "i_brand_id": "k % 50",
        "i_brand": _PAD.format("p_brand"), "i_class_id": "k % 16", "i_class": "case when p_size <= 10 then 'small ' else ' large' end",
        "i_category_id": "k % 10", "i_category": _PAD.format("p_type"), "i_manufact_id": "k % 30", "i_manufact": "concat('Manufact#', cast(k % 30 as {text}), ' ')",
        "i_size": "concat(cast(p_size as {text}), ' ')", "i_formulation": "concat(' ', cast(k % 13 as {text}), 'ml')", "i_color": "case when k % 2 = 0 then 'red ' else ' blue' end",
        "i_units": "'Each  '", "i_container": "' Unknown '", "i_manager_id": "k % 10", "i_product_name": _PAD.format("p_name")}),
    "store": ("supplier", {
        "s_store_sk": "k", "s_store_id": "concat('STORE', cast(k as {text}))", "s_rec_start_date": "cast('1995-01-01' as date)",
        "s_rec_end_date": "case when k % 19 = 0 then cast('1999-12-31' as date) end", "s_closed_date_sk": "case when k % 17 = 0 then 2452091 end",
        "s_store_name": "s_name", "s_number_employees": "50 + k % 250", "s_floor_space": "case when k % 13 <> 0 then k * 7919 % 400000 end",
        "s_hours": "case when k % 2 = 0 then '8AM-8PM' else '8AM-4PM' end", "s_manager": "concat('Manager ', cast(k % 40 as {text}))", "s_market_id": "n_regionkey",
        "s_market_desc": "concat('Market of ', r_name)", "s_division_id": "n_regionkey", "s_division_name": "r_name", "s_company_id": "k % 2 + 1",
        "s_company_name": "concat('Company ', cast(k % 2 + 1 as {text}))", "s_city": "n_name", "s_state": "substr(n_name, 1, 2)", "s_zip": _ZIP, "s_country": "r_name",
        "s_gmt_offset": "cast(-(k % 12) as decimal(5,2))", "s_tax_precentage": "cast(k % 9 as decimal(5,2))"}),
    "promotion": ("priority", {
        "p_promo_sk": "k", "p_promo_id": "concat('PROMO', cast(k as {text}))", "p_start_date_sk": "2449719 + (k - 1) * 365",
        "p_end_date_sk": "2449719 + (k - 1) * 365 + 500", "p_item_sk": "case when k = 4 then 1 end",
        "p_cost": "cast(case when k = 2 then 0 when k <> 3 then k * 1000 end as decimal(15,2))", "p_response_target": "1", "p_promo_name": "p_name",
        "p_channel_dmail": "case when k % 2 = 0 then 'Y' else 'N' end", "p_channel_email": "case when k <= 2 then 'Y' else 'N' end",
        "p_channel_catalog": "case when k % 2 = 0 then 'Y' else 'N' end", "p_channel_tv": "case when k % 2 = 1 then 'Y' else 'N' end",
        "p_channel_radio": "'N'", "p_channel_press": "'N'", "p_channel_event": "'N'", "p_channel_demo": "'N'",
        "p_purpose": "case when k % 2 = 1 then 'Unknown' else 'Sales' end", "p_discount_active": "'N'"}),
    "household_demographics": ("twenty", {
        "hd_demo_sk": "k", "hd_income_band_sk": "(k - 1) % 20 + 1", "hd_buy_potential": "case when k % 2 = 0 then '>10000' else 'Unknown' end",
        "hd_dep_count": "k % 5", "hd_vehicle_count": "k % 4"}),
    "web_site": ("nation", {
        "web_site_sk": "k", "web_site_id": "concat('WEB', cast(k as {text}))", "web_name": "concat('site_', cast(k as {text}))", "web_open_date_sk": "2449719 + k",
        "web_close_date_sk": "case when k % 6 = 0 then 2452091 end", "web_class": "'Unknown'", "web_mkt_id": "k % 6", "web_city": "n_name", "web_country": "r_name",
        "web_gmt_offset": "cast(-(k % 12) as decimal(5,2))", "web_tax_percentage": "cast(k % 9 as decimal(5,2))"}),
    "web_page": ("line", {
        "wp_web_page_sk": "k", "wp_web_page_id": "concat('PAGE', cast(k as {text}))", "wp_autogen_flag": "case when k % 2 = 0 then 'Y' else 'N' end",
        "wp_url": "'http://www.example.org'", "wp_type": "case k when 1 then 'welcome' when 2 then 'protected' when 3 then 'feedback' else 'general' end",
        "wp_char_count": "k * 900", "wp_link_count": "k + 3", "wp_image_count": "k % 4", "wp_max_ad_count": "k % 3"}),
    "warehouse": ("supplier", {
        "w_warehouse_sk": "k", "w_warehouse_id": "concat('WH', cast(k as {text}))", "w_warehouse_name": "concat('Warehouse ', cast(k as {text}))",
        "w_warehouse_sq_ft": "k % 900 * 1000", "w_city": "n_name", "w_state": "substr(n_name, 1, 2)", "w_zip": _ZIP, "w_country": "r_name",
        "w_gmt_offset": "cast(-(k % 12) as decimal(5,2))"}),
    "ship_mode": ("line", {
        "sm_ship_mode_sk": "k", "sm_ship_mode_id": "concat('SM', cast(k as {text}))", "sm_type": "case when k % 2 = 0 then 'EXPRESS' else 'REGULAR' end",
        "sm_code": "case when k % 3 = 0 then 'AIR' else 'SEA' end", "sm_carrier": "concat('Carrier ', cast(k as {text}))"}),
    "reason": ("line", {
        "r_reason_sk": "k", "r_reason_id": "concat('REASON', cast(k as {text}))", "r_reason_desc": "concat(' Reason ', cast(k as {text}), '  ')"}),
    "income_band": ("twenty", {
        "ib_income_band_sk": "k", "ib_lower_bound": "(k - 1) * 10000 + case when k > 1 then 1 else 0 end", "ib_upper_bound": "k * 10000"}),
    "call_center": ("nation", {
        "cc_call_center_sk": "k", "cc_call_center_id": "concat('CC', cast(k as {text}))", "cc_name": "n_name", "cc_class": "case when k % 2 = 0 then 'large' else 'small' end",
        "cc_employees": "k * 7", "cc_sq_ft": "k * 100", "cc_hours": "'8AM-8PM'", "cc_mkt_id": "k % 6", "cc_division": "k % 3", "cc_company": "k % 2",
        "cc_country": "r_name", "cc_gmt_offset": "cast(-(k % 12) as decimal(5,2))", "cc_tax_percentage": "cast(k % 9 as decimal(5,2))"}),
    "catalog_page": ("line", {
        "cp_catalog_page_sk": "k", "cp_catalog_page_id": "concat('CP', cast(k as {text}))", "cp_start_date_sk": "2449719 + k", "cp_end_date_sk": "2449719 + k * 90",
        "cp_department": "'DEPARTMENT'", "cp_catalog_number": "k % 4", "cp_catalog_page_number": "k", "cp_description": "concat('Page ', cast(k as {text}))",
        "cp_type": "case when k % 2 = 0 then 'monthly' else 'bi-annual' end"}),
}


def sql_type(declared: str) -> str:
    """The type a column keeps: keys and other whole numbers are wide, so they may outgrow the source's."""
    return "bigint" if declared == "int" else declared


def columns(table: str, text: str, days: str) -> list[tuple[str, str, str]]:
    """(column, expression, type) in source order; ``days``: the engine's days of ``d`` since 2000-01-01."""
    rules = RULES[table][1]
    out = []
    for f in raw_schema(table).fields:
        rule = rules.get(f.name, "null").format(text=text).replace("datediff_2000", days)
        out.append((f.name, rule, sql_type(f.dataType.simpleString())))
    return out


def raw_table(tables, table: str) -> DataFrame:
    """A raw-shaped table over the driver's tables (``tables``: its readers by name)."""
    base = RULES[table][0]
    query = BASES[base]
    spark = tables.spark
    names = [t for t in ("customer", "nation", "region", "part", "supplier", "orders", "lineitem", "events") if f" {t}" in query]
    rows = spark.sql(_named(query, names), **{t: getattr(tables, t) for t in names})
    days = "datediff(d, date'2000-01-01')"
    return rows.select(*[F.expr(f"cast({e} as {kind})").alias(c) for c, e, kind in columns(table, "string", days)])


def _named(query: str, names: list[str]) -> str:
    """The base query with its tables as arguments, so no view is left in the session."""
    for t in names:
        query = query.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return query


def oracle_table(table: str) -> str:
    """The same rows as a DuckDB SELECT."""
    days = "(d - DATE '2000-01-01')"
    kinds = {"string": "VARCHAR"}
    cols = ", ".join(f"CAST({e} AS {kinds.get(kind, kind)}) AS {c}" for c, e, kind in columns(table, "VARCHAR", days))
    return f"SELECT {cols} FROM ({BASES[RULES[table][0]]}) base"
