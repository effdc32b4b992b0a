"""Oracle SQL (DuckDB) for N01-N20 and G14, stated directly over the
mart CTEs (correlated EXISTS, FILTER clauses, plain multi-joins)."""

from __future__ import annotations

from shopstar.plans.oracle import avg_c, cents, hundredths, pct_c, rdiv, with_marts
from shopstar.plans.tables_sql import clean_rows


def rev(col: str) -> str:
    return f"CAST(sum({col}) AS DOUBLE)"


def _per_channel(template: str, specs) -> str:
    return "\nUNION ALL\n".join(template.format(**s) for s in specs)


_REMOTE = [dict(ch="web", f="web_sales", p="ws"), dict(ch="catalog", f="catalog_sales", p="cs")]
_ALL = [dict(ch="store", f="fact_store_sales", p="ss", num="ss_ticket_number"),
        dict(ch="web", f="fact_web_sales", p="ws", num="ws_order_number"),
        dict(ch="catalog", f="fact_catalog_sales", p="cs", num="cs_order_number")]

_BORN = "TRY_CAST(printf('%04d-%02d-%02d', c_birth_year, c_birth_month, c_birth_day) AS DATE)"
_AGE = (f"(2002 - year({_BORN}) - CASE WHEN 1 < month({_BORN}) OR (1 = month({_BORN}) AND 1 < day({_BORN})) "
        "THEN 1 ELSE 0 END)")

SQL = {
    "n01_fulfilment_lag": with_marts(_per_channel(
        "SELECT '{ch}' AS channel, CAST({p}_ship_date_sk - {p}_sold_date_sk AS INTEGER) AS lag_days, "
        "count(*) AS line_items FROM {f} GROUP BY 2", _REMOTE)),
    "n02_revenue_by_ship_mode": with_marts(f"""
SELECT channel, sm.sm_type, count(*) AS line_items, {rev('paid')} AS revenue FROM (
  SELECT 'web' AS channel, ws_ship_mode_sk AS k, ws_net_paid AS paid FROM web_sales
  UNION ALL SELECT 'catalog', cs_ship_mode_sk, cs_net_paid FROM catalog_sales) t
JOIN ship_mode sm ON t.k = sm.sm_ship_mode_sk GROUP BY channel, sm.sm_type"""),
    "n02_revenue_by_warehouse": with_marts(f"""
SELECT channel, w.w_warehouse_name, count(*) AS line_items, {rev('paid')} AS revenue FROM (
  SELECT 'web' AS channel, ws_warehouse_sk AS k, ws_net_paid AS paid FROM web_sales
  UNION ALL SELECT 'catalog', cs_warehouse_sk, cs_net_paid FROM catalog_sales) t
JOIN warehouse w ON t.k = w.w_warehouse_sk GROUP BY channel, w.w_warehouse_name"""),
    "n03_payer_vs_recipient": with_marts(f"""
SELECT payer.cd_education_status AS bill_education, payer.cd_gender AS bill_gender,
       recipient.cd_education_status AS ship_education, recipient.cd_gender AS ship_gender,
       count(*) AS line_items, {rev('cs_net_paid')} AS revenue
FROM catalog_sales, ({clean_rows('customer_demographics')}) payer, ({clean_rows('customer_demographics')}) recipient
WHERE cs_bill_cdemo_sk = payer.cd_demo_sk AND cs_ship_cdemo_sk = recipient.cd_demo_sk
GROUP BY ALL"""),
    "n04_gift_share_by_year": with_marts(f"""
SELECT year, line_items, gift_line_items, {hundredths(rdiv('10000 * gift_line_items', 'line_items'))} AS gift_pct
FROM (SELECT year, count(*) AS line_items, count(*) FILTER (WHERE ws_bill_addr_sk <> ws_ship_addr_sk) AS gift_line_items
      FROM web_sales JOIN dim_date ON ws_sold_date_sk = date_sk GROUP BY year) t"""),
    "n05_promotion_activity": with_marts(f"""
SELECT p_promo_name AS promo_name, count(*) AS line_items,
       count(*) FILTER (WHERE ss_sold_date_sk >= p_start_date_sk AND ss_sold_date_sk <= p_end_date_sk) AS in_window_line_items,
       count(*) FILTER (WHERE ss_item_sk = p_item_sk) AS item_specific_line_items
FROM fact_store_sales JOIN ({clean_rows('promotion')}) p ON ss_promo_sk = p_promo_sk
GROUP BY p_promo_name"""),
    "n06_buyer_income_band": with_marts(f"""
SELECT ib.ib_lower_bound, ib.ib_upper_bound, count(*) AS line_items, {rev('ss.ss_net_paid')} AS revenue
FROM store_sales ss
JOIN household_demographics hd ON ss.ss_hdemo_sk = hd.hd_demo_sk
JOIN income_band ib ON hd.hd_income_band_sk = ib.ib_income_band_sk
GROUP BY 1, 2"""),
    "n07_customer_age_bands": with_marts(f"""
SELECT CASE WHEN {_BORN} IS NULL THEN 'unknown' WHEN {_AGE} < 30 THEN 'under 30' WHEN {_AGE} < 45 THEN '30-44'
            WHEN {_AGE} < 60 THEN '45-59' ELSE '60+' END AS age_band,
       count(*) AS customers
FROM ({clean_rows('customer')}) c GROUP BY 1"""),
    "n08_current_versions": with_marts(f"""
SELECT 'store' AS entity, count(*) - count(s_closed_date_sk) AS current_rows, count(*) AS total_rows FROM ({clean_rows('store')}) s
UNION ALL
SELECT 'item', count(*) - count(valid_to), count(*) FROM dim_item"""),
    "n09_item_gross_margin": with_marts(f"""
SELECT item_sk, item_id, CAST(current_price - wholesale_cost AS DOUBLE) AS gross_margin,
       {pct_c(cents('current_price - wholesale_cost'), cents('current_price'))} AS margin_pct
FROM dim_item"""),
    "n10_promo_cost_per_transaction": with_marts(f"""
SELECT p.promo_name, count(*) AS transactions, CAST(p.cost AS DOUBLE) AS cost,
       {avg_c(cents('p.cost'), 'count(*)')} AS cost_per_transaction
FROM fact_store_sales f JOIN dim_promotion p ON f.ss_promo_sk = p.promo_sk
GROUP BY p.promo_sk, p.promo_name, p.cost"""),
    "n11_same_day_last_year": with_marts(f"""
, daily AS (SELECT ss_sold_date_sk AS k, CAST(sum(ss_net_paid) AS DOUBLE) AS paid FROM fact_store_sales GROUP BY 1)
SELECT d_date AS full_date, today.paid AS revenue, year_ago.paid AS revenue_same_day_ly, quarter_ago.paid AS revenue_same_day_lq
FROM ({clean_rows('date_dim')}) cal JOIN daily today ON today.k = d_date_sk
LEFT JOIN daily year_ago ON year_ago.k = d_same_day_ly
LEFT JOIN daily quarter_ago ON quarter_ago.k = d_same_day_lq"""),
    "n12_sale_time_profile": with_marts(f"""
SELECT cd_education_status, hd_income_band_sk, ca_state, count(*) AS line_items, {rev('ss_net_paid')} AS revenue
FROM store_sales LEFT JOIN ({clean_rows('customer_demographics')}) cd ON ss_cdemo_sk = cd_demo_sk
LEFT JOIN household_demographics ON ss_hdemo_sk = hd_demo_sk
LEFT JOIN ({clean_rows('customer_address')}) ca ON ss_addr_sk = ca_address_sk
GROUP BY ALL"""),
    "n13_basket_by_channel": with_marts(_per_channel(
        "SELECT '{ch}' AS channel, count(*) AS receipts, "
        + hundredths(rdiv("100 * sum(lines)", "count(*)")) + " AS avg_lines, "
        + avg_c("sum(vc)", "count(vc)") + " AS avg_receipt_value "
        "FROM (SELECT {num}, count(*) AS lines, sum(CAST({p}_net_paid * 100 AS BIGINT)) AS vc FROM {f} GROUP BY {num}) t",
        _ALL)),
    "n14_return_match": with_marts("""
SELECT 'store' AS channel, count(*) AS returns,
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fact_store_sales f
                                      WHERE f.ss_ticket_number = r.sr_ticket_number AND f.ss_item_sk = r.sr_item_sk)) AS matched_returns,
       CAST(sum(sr_net_loss) AS DOUBLE) AS net_loss
FROM store_returns r
UNION ALL
SELECT 'web', count(*),
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fact_web_sales f
                                      WHERE f.ws_order_number = r.wr_order_number AND f.ws_item_sk = r.wr_item_sk)),
       CAST(sum(wr_net_loss) AS DOUBLE)
FROM web_returns r
UNION ALL
SELECT 'catalog', count(*),
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fact_catalog_sales f
                                      WHERE f.cs_order_number = r.cr_order_number AND f.cs_item_sk = r.cr_item_sk)),
       CAST(sum(cr_net_loss) AS DOUBLE)
FROM catalog_returns r"""),
    "n15_refund_mismatch": with_marts("""
SELECT 'web' AS channel, count(*) AS returns,
       count(*) FILTER (WHERE wr_refunded_customer_sk IS DISTINCT FROM wr_returning_customer_sk) AS mismatched
FROM web_returns
UNION ALL
SELECT 'catalog', count(*), count(*) FILTER (WHERE cr_refunded_customer_sk IS DISTINCT FROM cr_returning_customer_sk)
FROM catalog_returns"""),
    "n16_money_identity_check": with_marts(_per_channel(
        "SELECT '{ch}' AS channel, count(*) AS line_items, "
        "count(*) FILTER (WHERE {p}_net_paid <> {p}_ext_sales_price - {p}_coupon_amt) AS bad_net_paid, "
        "count(*) FILTER (WHERE {p}_ext_sales_price <> {p}_ext_list_price - {p}_ext_discount_amt) AS bad_sales_price, "
        "count(*) FILTER (WHERE {p}_net_paid_inc_tax <> {p}_net_paid + {p}_ext_tax) AS bad_inc_tax, "
        "count(*) FILTER (WHERE {p}_net_profit <> {p}_net_paid - {p}_ext_wholesale_cost{ship}) AS bad_profit "
        "FROM {f}",
        [dict(s, ship="" if s["p"] == "ss" else f" - {s['p']}_ext_ship_cost") for s in _ALL])),
    "n17_call_center_revenue": with_marts(f"""
SELECT cc.cc_name, count(*) AS line_items, {rev('f.cs_net_paid')} AS revenue
FROM fact_catalog_sales f JOIN call_center cc ON f.cs_call_center_sk = cc.cc_call_center_sk
GROUP BY cc.cc_name"""),
    "n18_corporate_revenue": with_marts(f"""
SELECT s_division_name AS division_name, s_company_name AS company_name, {rev('ss_net_paid')} AS revenue
FROM fact_store_sales JOIN ({clean_rows('store')}) s ON ss_store_sk = s_store_sk
GROUP BY ALL"""),
    "n19_local_sale_hour": with_marts("""
SELECT CAST(hour(CAST(DATE '2000-01-01' + (f.ss_sold_date_sk - 2451545) AS TIMESTAMP)
                 + to_seconds(f.ss_sold_time_sk) + to_minutes(CAST(c.gmt_offset * 60 AS INTEGER))) AS INTEGER) AS local_hour,
       count(*) AS line_items
FROM fact_store_sales f JOIN dim_customer c ON f.ss_customer_sk = c.customer_sk
GROUP BY 1"""),
    "n20_items_by_manager": with_marts(f"""
SELECT i_manager_id AS manager_id, count(*) AS items, count(DISTINCT i_category) AS categories
FROM ({clean_rows('item')}) i GROUP BY i_manager_id"""),
    "g14_channel_pivot": with_marts("""
SELECT d.year,
       CAST(sum(CASE WHEN channel = 'store' THEN net_paid END) AS DOUBLE) AS store,
       CAST(sum(CASE WHEN channel = 'web' THEN net_paid END) AS DOUBLE) AS web,
       CAST(sum(CASE WHEN channel = 'catalog' THEN net_paid END) AS DOUBLE) AS catalog
FROM lines JOIN dim_date d ON lines.sold_date_sk = d.date_sk
GROUP BY d.year"""),
}
