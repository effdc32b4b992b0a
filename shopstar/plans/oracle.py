"""DuckDB statements of the derived marts and of every report (the oracle).

The oracle restates each derivation rule of ``sources/testmarts.py`` as
SQL CTEs over the driver's tables, and each report as plain SQL over those
CTEs.  DuckDB divides decimals in DOUBLE, so every rounded ratio is
computed exactly in integer cents and rounded half away from zero
(``rdiv``), then handed over as DOUBLE like the Spark side.
"""

from __future__ import annotations


def cents(expr: str) -> str:
    """Exact integer cents of a DECIMAL(p,2) expression."""
    return f"CAST(({expr}) * 100 AS BIGINT)"


def rdiv(n: str, d: str) -> str:
    """round(n / d) to an integer, half away from zero; NULL when d = 0."""
    return (f"(CASE WHEN ({d}) = 0 THEN NULL ELSE sign({n}) * sign({d}) * "
            f"((abs({n}) * 2 + abs({d})) // (2 * abs({d}))) END)")


def hundredths(q: str) -> str:
    return f"(CAST({q} AS DOUBLE) / 100)"


def millions_c(sum_cents: str) -> str:
    """ROUND(sum / 1e6, 2) from a sum in cents."""
    return hundredths(rdiv(sum_cents, "1000000"))


def pct_c(num_cents: str, den_cents: str) -> str:
    """ROUND(100 * num / NULLIF(den, 0), 2) from two sums in the same unit."""
    return hundredths(rdiv(f"10000 * ({num_cents})", den_cents))


def avg_c(sum_cents: str, count: str) -> str:
    """ROUND(sum / count, 2) from a sum in cents (i.e. ROUND(AVG(x), 2))."""
    return hundredths(rdiv(sum_cents, count))


def ratio_c(num_cents: str, den_cents: str) -> str:
    """ROUND(num / NULLIF(den, 0), 2) for two money sums in cents."""
    return hundredths(rdiv(f"100 * ({num_cents})", den_cents))


def julian(d: str) -> str:
    return f"CAST((CAST({d} AS DATE) - DATE '2000-01-01') + 2451545 AS INTEGER)"


_LINES = f"""
lines0 AS (
  SELECT l.l_orderkey AS order_number, l.l_linenumber AS line_number, l.l_returnflag AS return_flag,
         {julian('o.o_orderdate')} AS sold_date_sk,
         {julian('l.l_shipdate')} AS ship_date_sk,
         CAST((l.l_orderkey * 7919 + l.l_linenumber * 104729) % 86400 AS INTEGER) AS sold_time_sk,
         l.l_partkey AS item_sk,
         l.l_suppkey AS supp_sk,
         CASE WHEN l.l_orderkey % 11 <> 0 THEN o.o_custkey END AS customer_sk,
         o.o_custkey AS order_custkey,
         CASE WHEN regexp_extract(o.o_orderpriority, '^([0-9]+)', 1) NOT IN ('', '5') THEN CAST(regexp_extract(o.o_orderpriority, '^([0-9]+)', 1) AS INTEGER) END AS promo_sk,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) AS ext_list_price,
         CAST(round(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS ext_discount_amt,
         CAST(round(CAST(l.l_extendedprice AS DECIMAL(12,2)) * 0.95, 2) AS DECIMAL(12,2)) AS ext_wholesale_cost,
         CAST(l.l_tax AS DECIMAL(4,2)) AS tax_rate,
         CAST(l.l_orderkey % 7 AS INTEGER) AS channel_code
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
lines1 AS (
  SELECT *, CAST(ext_list_price - ext_discount_amt AS DECIMAL(12,2)) AS ext_sales_price,
         CAST(ext_list_price - ext_discount_amt AS DECIMAL(12,2)) AS net_paid FROM lines0
),
lines2 AS (
  SELECT *, CAST(round(net_paid * tax_rate, 2) AS DECIMAL(12,2)) AS ext_tax FROM lines1
),
lines AS (
  SELECT *,
         CAST(CAST({rdiv(cents('ext_wholesale_cost'), 'quantity')} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(12,2)) AS wholesale_cost,
         CAST(CAST({rdiv(cents('ext_list_price'), 'quantity')} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(12,2)) AS list_price,
         CAST(CAST({rdiv(cents('ext_sales_price'), 'quantity')} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(12,2)) AS sales_price,
         CAST(0 AS DECIMAL(12,2)) AS coupon_amt,
         CAST(net_paid + ext_tax AS DECIMAL(12,2)) AS net_paid_inc_tax,
         CAST(net_paid - ext_wholesale_cost AS DECIMAL(12,2)) AS net_profit,
         CAST(round(ext_list_price * 0.02, 2) AS DECIMAL(12,2)) AS ext_ship_cost,
         CASE WHEN channel_code <= 3 THEN 'store' WHEN channel_code <= 5 THEN 'catalog' ELSE 'web' END AS channel
  FROM lines2
)"""

_PRICES = ["quantity", "wholesale_cost", "list_price", "sales_price", "ext_discount_amt", "ext_sales_price",
           "ext_wholesale_cost", "ext_list_price", "ext_tax", "coupon_amt", "net_paid", "net_paid_inc_tax"]
_HDEMO = "CAST(CASE WHEN customer_sk IS NOT NULL THEN customer_sk % 20 + 1 END AS INTEGER)"
_SHIP_CUST = ("CAST(CASE WHEN line_number % 4 = 0 THEN NULL WHEN line_number % 4 = 1 THEN order_custkey + 1 "
              "ELSE order_custkey END AS BIGINT)")

_PARTIES = ("customer_sk % 40 + 1 AS {p}_bill_cdemo_sk, customer_sk AS {p}_bill_addr_sk, "
            f"{_SHIP_CUST} % 40 + 1 AS " + "{p}_ship_cdemo_sk, "
            f"CASE WHEN order_number % 3 = 0 THEN customer_sk ELSE {_SHIP_CUST} END AS " + "{p}_ship_addr_sk")


def _staging_sql(p: str, where: str, keys: str) -> str:
    prices = ", ".join(f"{m} AS {p}_{m}" for m in _PRICES)
    if p == "ss":
        tail = "net_profit AS ss_net_profit"
    else:
        tail = (f"ext_ship_cost AS {p}_ext_ship_cost, CAST(net_paid + ext_ship_cost AS DECIMAL(12,2)) AS {p}_net_paid_inc_ship, "
                f"CAST(net_paid_inc_tax + ext_ship_cost AS DECIMAL(12,2)) AS {p}_net_paid_inc_ship_tax, "
                f"CAST(net_profit - ext_ship_cost AS DECIMAL(12,2)) AS {p}_net_profit")
    return (f"SELECT sold_date_sk AS {p}_sold_date_sk, sold_time_sk AS {p}_sold_time_sk, item_sk AS {p}_item_sk, "
            f"promo_sk AS {p}_promo_sk, {keys}, {prices}, {tail} FROM lines WHERE {where}")


_FACTS = f"""
store_sales AS (
  {_staging_sql('ss', 'channel_code <= 3', f'customer_sk AS ss_customer_sk, customer_sk % 40 + 1 AS ss_cdemo_sk, {_HDEMO} AS ss_hdemo_sk, customer_sk AS ss_addr_sk, supp_sk AS ss_store_sk, order_number AS ss_ticket_number')}
),
fact_store_sales AS (SELECT * EXCLUDE (ss_cdemo_sk, ss_hdemo_sk, ss_addr_sk) FROM store_sales),
web_sales AS (
  {_staging_sql('ws', 'channel_code = 6', f'ship_date_sk AS ws_ship_date_sk, customer_sk AS ws_bill_customer_sk, {_HDEMO} AS ws_bill_hdemo_sk, {_SHIP_CUST} AS ws_ship_customer_sk, {_PARTIES.format(p="ws")}, line_number AS ws_web_page_sk, CAST(supp_sk % 3 + 1 AS INTEGER) AS ws_web_site_sk, CAST(order_number % 5 + 1 AS INTEGER) AS ws_ship_mode_sk, supp_sk AS ws_warehouse_sk, order_number AS ws_order_number')}
),
fact_web_sales AS (SELECT * EXCLUDE (ws_bill_cdemo_sk, ws_bill_addr_sk, ws_ship_cdemo_sk, ws_ship_addr_sk, ws_ship_date_sk, ws_bill_hdemo_sk, ws_ship_mode_sk, ws_warehouse_sk) FROM web_sales),
catalog_sales AS (
  {_staging_sql('cs', 'channel_code IN (4, 5)', f'ship_date_sk AS cs_ship_date_sk, customer_sk AS cs_bill_customer_sk, {_HDEMO} AS cs_bill_hdemo_sk, {_SHIP_CUST} AS cs_ship_customer_sk, {_PARTIES.format(p="cs")}, CAST(supp_sk % 4 + 1 AS INTEGER) AS cs_call_center_sk, line_number AS cs_catalog_page_sk, CAST(order_number % 5 + 1 AS INTEGER) AS cs_ship_mode_sk, supp_sk AS cs_warehouse_sk, order_number AS cs_order_number')}
),
fact_catalog_sales AS (SELECT * EXCLUDE (cs_bill_cdemo_sk, cs_bill_addr_sk, cs_ship_cdemo_sk, cs_ship_addr_sk, cs_ship_date_sk, cs_bill_hdemo_sk, cs_ship_mode_sk, cs_warehouse_sk) FROM catalog_sales),
store_returns AS (
  SELECT CAST(ship_date_sk + 14 AS INTEGER) AS sr_returned_date_sk, item_sk AS sr_item_sk,
         customer_sk AS sr_customer_sk, supp_sk AS sr_store_sk, line_number AS sr_reason_sk,
         order_number AS sr_ticket_number, quantity AS sr_return_quantity, net_paid AS sr_return_amt,
         CAST(round(net_paid * 0.10, 2) AS DECIMAL(12,2)) AS sr_net_loss
  FROM lines WHERE channel_code <= 3 AND return_flag = 'R'
),
web_returns AS (
  SELECT CAST(ship_date_sk + 14 AS INTEGER) AS wr_returned_date_sk, item_sk AS wr_item_sk,
         customer_sk AS wr_returning_customer_sk,
         CASE WHEN line_number % 3 = 0 THEN order_custkey + 2 ELSE customer_sk END AS wr_refunded_customer_sk,
         line_number AS wr_reason_sk, order_number AS wr_order_number, quantity AS wr_return_quantity,
         net_paid AS wr_return_amt, CAST(round(net_paid * 0.10, 2) AS DECIMAL(12,2)) AS wr_net_loss
  FROM lines WHERE channel_code = 6 AND return_flag = 'R'
),
catalog_returns AS (
  SELECT CAST(ship_date_sk + 14 AS INTEGER) AS cr_returned_date_sk, item_sk AS cr_item_sk,
         customer_sk AS cr_returning_customer_sk,
         CASE WHEN line_number % 3 = 0 THEN order_custkey + 2 ELSE customer_sk END AS cr_refunded_customer_sk,
         line_number AS cr_reason_sk, order_number AS cr_order_number, quantity AS cr_return_quantity,
         net_paid AS cr_return_amount, CAST(round(net_paid * 0.10, 2) AS DECIMAL(12,2)) AS cr_net_loss
  FROM lines WHERE channel_code IN (4, 5) AND return_flag = 'R'
)"""

_DIMS = f"""
date_bounds AS (
  SELECT min(d) AS lo, max(d) AS hi FROM (
    SELECT CAST(o_orderdate AS DATE) AS d FROM orders
    UNION ALL SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)
),
date_days AS (
  SELECT CAST(unnest(generate_series(make_date(year(lo), 1, 1), make_date(year(hi), 12, 31), INTERVAL 1 DAY)) AS DATE) AS full_date,
         year(hi) AS last_year
  FROM date_bounds
),
dim_date AS (
  SELECT {julian('full_date')} AS date_sk, full_date,
         CAST(year(full_date) AS INTEGER) AS year, CAST(quarter(full_date) AS INTEGER) AS quarter,
         CAST(month(full_date) AS INTEGER) AS month, CAST(day(full_date) AS INTEGER) AS day_of_month,
         CAST(dayofweek(full_date) AS INTEGER) AS day_of_week, dayname(full_date) AS day_name,
         CAST(floor(({julian('full_date')} - 2415021) / 7) + 1 AS INTEGER) AS week_seq,
         CAST((year(full_date) - 1900) * 12 + month(full_date) - 1 AS INTEGER) AS month_seq,
         CAST((year(full_date) - 1900) * 4 + quarter(full_date) - 1 AS INTEGER) AS quarter_seq,
         (month(full_date) = 1 AND day(full_date) = 1) OR (month(full_date) = 7 AND day(full_date) = 4)
           OR (month(full_date) = 12 AND day(full_date) = 25) AS is_holiday,
         dayofweek(full_date) IN (0, 6) AS is_weekend,
         year(full_date) = last_year AS is_current_year,
         CAST(year(full_date) * 100 + month(full_date) AS INTEGER) AS sold_ym,
         {julian("full_date - INTERVAL 12 MONTH")} AS same_day_ly,
         {julian("full_date - INTERVAL 3 MONTH")} AS same_day_lq
  FROM date_days
),
dim_item AS (
  SELECT p_partkey AS item_sk,
         'ITEM' || lpad(CAST(p_partkey AS VARCHAR), greatest(12, length(CAST(p_partkey AS VARCHAR)))::INTEGER, '0') AS item_id,
         p_name AS product_name, p_brand AS brand, CAST(nullif(regexp_extract(p_brand, '([0-9]+)$', 1), '') AS INTEGER) AS brand_id,
         CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 25 THEN 'medium' ELSE 'large' END AS class,
         p_type AS category,
         'Manufact#' || CAST(p_partkey % 10 AS VARCHAR) AS manufacturer,
         CAST(p_partkey % 10 AS INTEGER) AS manager_id,
         CAST(p_retailprice AS DECIMAL(7,2)) AS current_price,
         CAST(round(CAST(p_retailprice AS DECIMAL(7,2)) * 0.60, 2) AS DECIMAL(7,2)) AS wholesale_cost,
         DATE '1995-01-01' AS valid_from,
         CASE WHEN p_partkey % 10 = 0 THEN DATE '2000-12-31' END AS valid_to
  FROM part
),
dim_customer AS (
  SELECT c_custkey AS customer_sk, c_name AS customer_id,
         CASE WHEN c_custkey % 3 = 0 THEN 'Y' WHEN c_custkey % 3 = 1 THEN 'N' END AS preferred_flag,
         CAST(1930 + c_custkey % 60 AS INTEGER) AS birth_year,
         CAST(1 + c_custkey % 12 AS INTEGER) AS birth_month,
         CAST(1 + c_custkey % 31 AS INTEGER) AS birth_day,
         CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 1 THEN 'M' ELSE 'F' END AS gender,
         CASE c_custkey % 4 WHEN 0 THEN 'Primary' WHEN 1 THEN 'Secondary' WHEN 2 THEN 'College' END AS education_status,
         c_mktsegment AS credit_rating, n_name AS state, r_name AS country,
         CAST(-(c_nationkey % 12) AS DECIMAL(5,2)) AS gmt_offset,
         CAST(c_custkey % 20 + 1 AS INTEGER) AS hdemo_sk
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
),
dim_store AS (
  SELECT s_suppkey AS store_sk,
         'STORE' || lpad(CAST(s_suppkey AS VARCHAR), greatest(11, length(CAST(s_suppkey AS VARCHAR)))::INTEGER, '0') AS store_id,
         s_name AS store_name, CAST(50 + s_suppkey % 250 AS INTEGER) AS employees,
         CAST(CASE WHEN s_suppkey % 13 <> 0 THEN (s_suppkey * 7919) % 400000 END AS INTEGER) AS floor_space,
         n_regionkey AS market_id, n_name AS city, r_name AS state,
         n_regionkey AS division_id, r_name AS division_name,
         CAST(s_suppkey % 2 + 1 AS INTEGER) AS company_id,
         'Company ' || CAST(s_suppkey % 2 + 1 AS VARCHAR) AS company_name,
         CAST(CASE WHEN s_suppkey % 17 = 0 THEN 2452091 END AS INTEGER) AS closed_date_sk
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
),
promo_src AS (
  SELECT regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS digit, min(o_orderpriority) AS priority
  FROM orders WHERE regexp_extract(o_orderpriority, '^([0-9]+)', 1) NOT IN ('', '5') GROUP BY 1
),
dim_promotion AS (
  SELECT CAST(digit AS INTEGER) AS promo_sk, 'PROMO' || lpad(digit, greatest(11, length(digit))::INTEGER, '0') AS promo_id,
         regexp_extract(priority, '^[0-9]+-(.*)$', 1) AS promo_name,
         CASE WHEN CAST(digit AS INTEGER) % 2 = 1 THEN 'Unknown' ELSE 'Sales' END AS purpose,
         CAST(CASE WHEN CAST(digit AS INTEGER) = 2 THEN 0.00 WHEN CAST(digit AS INTEGER) = 3 THEN NULL
                   ELSE CAST(digit AS INTEGER) * 1000.00 END AS DECIMAL(15,2)) AS cost,
         1 AS response_target,
         CASE WHEN CAST(digit AS INTEGER) <= 2 THEN 'Y' ELSE 'N' END AS channel_email,
         CASE WHEN CAST(digit AS INTEGER) % 2 = 0 THEN 'Y' ELSE 'N' END AS channel_catalog,
         CASE WHEN CAST(digit AS INTEGER) % 2 = 1 THEN 'Y' ELSE 'N' END AS channel_tv,
         CAST(2449719 + (CAST(digit AS INTEGER) - 1) * 365 AS INTEGER) AS start_date_sk,
         CAST(2449719 + (CAST(digit AS INTEGER) - 1) * 365 + 500 AS INTEGER) AS end_date_sk,
         CAST(CASE WHEN CAST(digit AS INTEGER) = 4 THEN 1 END AS INTEGER) AS item_sk
  FROM promo_src
),
warehouse AS (
  SELECT s_suppkey AS w_warehouse_sk, 'Warehouse ' || CAST(s_suppkey AS VARCHAR) AS w_warehouse_name,
         n_name AS w_state
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
),
inventory AS (
  SELECT {julian("CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE)")} AS inv_date_sk,
         l_partkey AS inv_item_sk, l_suppkey AS inv_warehouse_sk,
         CAST(sum(l_quantity) AS INTEGER) AS inv_quantity_on_hand
  FROM lineitem GROUP BY 1, 2, 3
),
reason AS (
  SELECT r_reason_sk, ' Reason ' || CAST(r_reason_sk AS VARCHAR) || '  ' AS r_reason_desc,
         trim(' Reason ' || CAST(r_reason_sk AS VARCHAR) || '  ') AS r_reason_desc_clean
  FROM (SELECT DISTINCT l_linenumber AS r_reason_sk FROM lineitem)
),
time_dim AS (
  SELECT CAST(range AS INTEGER) AS t_time_sk, CAST(range // 3600 AS INTEGER) AS t_hour,
         CASE WHEN range // 3600 < 8 THEN 'third' WHEN range // 3600 < 16 THEN 'first' ELSE 'second' END AS t_shift
  FROM range(0, 86400)
),
web_page AS (
  SELECT * FROM (VALUES (1, 'welcome'), (2, 'protected'), (3, 'feedback'), (4, 'general'), (5, 'order'),
                        (6, 'ad'), (7, 'dynamic')) t(wp_web_page_sk, wp_type)
),
catalog_page AS (
  SELECT * FROM (VALUES (1, 'DEPARTMENT'), (2, 'HOME'), (3, 'SPORTS'), (4, 'TOYS'), (5, 'GARDEN'),
                        (6, 'JEWELRY'), (7, 'BOOKS')) t(cp_catalog_page_sk, cp_department)
),
ship_mode AS (
  SELECT * FROM (VALUES (1, 'EXPRESS'), (2, 'LIBRARY'), (3, 'NEXT DAY'), (4, 'OVERNIGHT'),
                        (5, 'REGULAR')) t(sm_ship_mode_sk, sm_type)
),
call_center AS (
  SELECT * FROM (VALUES (1, 'NY Metro'), (2, 'Mid Atlantic'), (3, 'North Midwest'),
                        (4, 'Pacific Northwest')) t(cc_call_center_sk, cc_name)
),
household_demographics AS (
  SELECT hd_demo_sk, CAST((hd_demo_sk - 1) % 20 + 1 AS INTEGER) AS hd_income_band_sk
  FROM (SELECT DISTINCT hdemo_sk AS hd_demo_sk FROM dim_customer)
),
income_band AS (
  SELECT ib_income_band_sk,
         CAST((ib_income_band_sk - 1) * 10000 + CASE WHEN ib_income_band_sk > 1 THEN 1 ELSE 0 END AS INTEGER) AS ib_lower_bound,
         CAST(ib_income_band_sk * 10000 AS INTEGER) AS ib_upper_bound
  FROM (SELECT DISTINCT hd_income_band_sk AS ib_income_band_sk FROM household_demographics)
),
run_log AS (
  SELECT event_id AS id, 'dump_' || event_type AS backup_type, ts AS started_at,
         CASE WHEN value < 45 THEN 'success' ELSE 'failed' END AS status,
         CAST(round(value * 1000000) AS BIGINT) AS size_bytes,
         CAST(floor(value) AS INTEGER) AS duration_secs, props AS notes
  FROM events
),
metrics AS (
  SELECT ts, 'node-' || CAST(user_id % 3 AS VARCHAR) AS instance, 'db' || CAST(user_id % 4 AS VARCHAR) AS datname,
         'pg_' || event_type AS metric, CAST(value AS DECIMAL(12,2)) AS value
  FROM events
)"""

PREFIX = "WITH " + _LINES.strip() + ",\n" + _FACTS.strip() + ",\n" + _DIMS.strip() + "\n"


def with_marts(body: str) -> str:
    """A complete oracle statement: mart CTEs followed by the report body."""
    return PREFIX + body.strip() + "\n"
