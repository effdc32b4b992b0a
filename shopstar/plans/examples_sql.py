"""Oracle SQL (DuckDB) for the documented examples D01-D32.

Stated from what each example computes, over the sale lines themselves
(``sale``: all channels, one row a line, keys named like the dimensions'), not
over the facts that the Spark reports read.  Row order is not part of the
comparison, so only a top-k orders.
"""

from __future__ import annotations

from shopstar.plans.oracle import cents, hundredths, pct_c, ratio_c, rdiv, with_marts

SALE = """,
sale AS (
  SELECT * EXCLUDE (net_profit), supp_sk AS store_sk, sold_date_sk AS date_sk,
         net_profit - CASE WHEN channel = 'store' THEN 0 ELSE ext_ship_cost END AS profit
  FROM lines
)
"""


def over_sales(body: str) -> str:
    return with_marts(SALE + body)


def total(measure: str) -> str:
    return f"CAST(sum({measure}) AS DOUBLE)"


def grouped(channel: str, by: str, dims: dict[str, str], optional: bool = False, **outputs: str) -> str:
    """Sale lines of a channel with dimensions (name -> key), grouped by attributes: attributes and named outputs."""
    joins = " ".join(f"{'LEFT ' if optional else ''}JOIN {dim} USING ({key})" for dim, key in dims.items())
    named = ", ".join(f"{e} AS {name}" for name, e in outputs.items())
    return over_sales(f"SELECT {by}, {named} FROM sale {joins} WHERE channel = '{channel}' GROUP BY ALL")


def best(statement: str, order: str, n: int) -> str:
    return f"{statement} ORDER BY {order} LIMIT {n}"


PAID, ROWS = total("net_paid"), "count(*)"
NEWEST = "inv_date_sk = (SELECT max(inv_date_sk) FROM inventory)"


def size_pretty_sql(b: str) -> str:
    """The size formatter restated in SQL (integer division truncates toward zero)."""
    def hr(x: str) -> str:
        return f"CASE WHEN ({x}) < 0 THEN (({x}) - 1) // 2 ELSE (({x}) + 1) // 2 END"
    parts = [f"WHEN abs({b}) < 10240 THEN CAST({b} AS VARCHAR) || ' bytes'"]
    level = f"({b}) // 512"
    units = ["kB", "MB", "GB", "TB"]
    for u in units:
        parts.append(f"WHEN abs({level}) < 20479 THEN CAST({hr(level)} AS VARCHAR) || ' {u}'")
        level = f"({level}) // 1024"
    return "CASE " + " ".join(parts) + f" ELSE CAST({hr(level)} AS VARCHAR) || ' PB' END"


def stock(attrs: str, value: str, where: str, dims: str) -> str:
    """Inventory positions with their item and warehouse."""
    return with_marts(f"SELECT {attrs}, {value} FROM inventory {dims} WHERE {where}")


ITEM = "JOIN dim_item ON item_sk = inv_item_sk"
PLACE = "JOIN warehouse ON w_warehouse_sk = inv_warehouse_sk"
ON_HAND = "CAST(sum(inv_quantity_on_hand) AS BIGINT) AS total_stock"

SQL = {
    "d01_star_join": over_sales("""
SELECT full_date, year, month, category, brand, quantity AS ss_quantity, CAST(net_paid AS DOUBLE) AS ss_net_paid,
       CAST(profit AS DOUBLE) AS ss_net_profit, customer_id, dim_customer.state, promo_name
FROM sale JOIN dim_date USING (date_sk) JOIN dim_item ON dim_item.item_sk = sale.item_sk JOIN dim_store USING (store_sk)
LEFT JOIN dim_customer ON dim_customer.customer_sk = sale.customer_sk LEFT JOIN dim_promotion ON dim_promotion.promo_sk = sale.promo_sk
WHERE channel = 'store'"""),
    "d02_monthly_store_revenue": grouped("store", "year, month", {"dim_date": "date_sk"}, revenue=PAID),
    "d03_holiday_revenue": grouped("store", "is_holiday", {"dim_date": "date_sk"}, transactions=ROWS, revenue=PAID),
    "d04_revenue_by_education": grouped("store", "education_status", {"dim_customer": "customer_sk"}, optional=True, revenue=PAID, orders=ROWS),
    "d05_top_customer_states": with_marts(best(
        "SELECT n_name AS state, count(*) AS customers FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL",
        "customers DESC, state NULLS LAST", 10)),
    "d06_preferred_revenue": grouped("store", "ifnull(preferred_flag, 'N') AS preferred", {"dim_customer": "customer_sk"}, optional=True, revenue=PAID),
    "d07_store_category_revenue": grouped("store", "category", {"dim_item": "item_sk"}, revenue=PAID),
    "d08_brand_margin": best(grouped(
        "store", "brand", {"dim_item": "item_sk"}, revenue=total("ext_sales_price"), cost=total("ext_wholesale_cost"), gross_profit=total("profit"),
        margin_pct=pct_c(f"sum({cents('profit')})", f"sum({cents('ext_sales_price')})")), "sum(profit) DESC NULLS FIRST, brand NULLS LAST", 20),
    "d09_promoted_vs_not": grouped("store", "if(promo_sk IS NULL, 'No Promotion', 'Promotion') AS promo_flag", {}, revenue=PAID, line_items=ROWS),
    "d10_promo_channel_effect": grouped("store", "channel_tv, channel_email", {"dim_promotion": "promo_sk"}, transactions=ROWS, revenue=PAID),
    # the promotion's cost counts once a sale line here ...
    "d11_roi_by_purpose": grouped("store", "purpose", {"dim_promotion": "promo_sk"}, promo_cost=total("cost"), revenue=PAID,
                                  revenue_per_cost=ratio_c(f"sum({cents('net_paid')})", f"sum({cents('cost')})")),
    # ... and once a promotion with sales here
    "d11_roi_by_purpose_corrected": over_sales(f"""
, sold AS (SELECT promo_sk, sum({cents('net_paid')}) AS paid FROM sale WHERE channel = 'store' GROUP BY ALL)
SELECT purpose, {total('cost')} AS promo_cost, CAST(sum(paid) AS DOUBLE) / 100 AS revenue,
       {ratio_c('sum(paid)', f"sum({cents('cost')})")} AS revenue_per_cost
FROM dim_promotion JOIN sold USING (promo_sk) GROUP BY ALL"""),
    "d12_store_state_revenue": grouped("store", "state", {"dim_store": "store_sk"}, revenue=PAID, transactions="count(DISTINCT order_number)"),
    "d13_store_size_revenue": grouped("store", "if(floor_space > 200000, 'large', 'small') AS store_size", {"dim_store": "store_sk"}, revenue=PAID),
    "d14_catalog_category_revenue": grouped("catalog", "category", {"dim_item": "item_sk"}, revenue=PAID),
    "d15_catalog_promotions": grouped("catalog", "purpose, channel_catalog", {"dim_promotion": "promo_sk"}, line_items=ROWS, revenue=PAID),
    "d16_channel_union_revenue": over_sales(f"SELECT channel, {PAID} AS total_revenue FROM sale GROUP BY ALL"),
    "d17_top_products": best(grouped("store", "product_name, category", {"dim_item": "item_sk"}, profit=total("profit")),
                             "sum(sale.profit) DESC NULLS FIRST, product_name NULLS LAST, category NULLS LAST", 10),
    "d18_avg_basket_size": over_sales(f"""
SELECT {hundredths(rdiv('100 * count(*)', 'count(DISTINCT order_number)'))} AS avg_basket_size FROM sale WHERE channel = 'store'"""),
    "d19_web_monthly_total": grouped("web", "year, month", {"dim_date": "date_sk"}, total_revenue=total("net_paid_inc_tax + ext_ship_cost")),
    "d20_gift_line_items": with_marts("SELECT count(*) FILTER (WHERE ws_bill_customer_sk <> ws_ship_customer_sk) AS gift_line_items FROM web_sales"),
    "d21_channel_totals": over_sales(f"SELECT channel, {PAID} AS revenue FROM sale GROUP BY ALL"),
    "d22_catalog_department_revenue": over_sales(f"""
SELECT cp_department, {PAID} AS revenue FROM sale JOIN catalog_page ON cp_catalog_page_sk = line_number WHERE channel = 'catalog' GROUP BY ALL"""),
    "d23_lowest_current_stock": best(stock("product_name AS i_product_name, category AS i_category", ON_HAND, f"{NEWEST} GROUP BY ALL", ITEM),
                                     "total_stock NULLS LAST, i_product_name, i_category", 20),
    "d24_item_stock_trend": stock("full_date AS d_date, w_warehouse_name", "inv_quantity_on_hand", "inv_item_sk = 1",
                                  f"JOIN dim_date ON date_sk = inv_date_sk {PLACE}"),
    "d25_low_stock": stock("product_name AS i_product_name, w_warehouse_name", "inv_quantity_on_hand",
                           f"{NEWEST} AND inv_quantity_on_hand < 10", f"{ITEM} {PLACE}"),
    "d26_top_return_reasons": with_marts("""
SELECT 'Reason ' || line_number AS r_reason_desc_clean, count(*) AS returns
FROM lines WHERE channel = 'store' AND return_flag = 'R' GROUP BY ALL"""),
    "d27_return_rate_by_category": over_sales(f"""
, back AS (SELECT order_number, item_sk, count(*) AS n FROM sale WHERE channel = 'store' AND return_flag = 'R' GROUP BY ALL),
joined AS (  -- a line returned n times is there n times, at least once
  SELECT category, ifnull(n, 0) AS returned, greatest(ifnull(n, 0), 1) AS sold
  FROM sale JOIN dim_item USING (item_sk) LEFT JOIN back USING (order_number, item_sk) WHERE channel = 'store')
SELECT category AS i_category, CAST(sum(returned) AS BIGINT) AS returns, CAST(sum(sold) AS BIGINT) AS sales,
       {hundredths(rdiv('CAST(10000 * sum(returned) AS BIGINT)', 'CAST(sum(sold) AS BIGINT)'))} AS return_rate_pct
FROM joined GROUP BY ALL"""),
    "d28_sales_by_shift": over_sales(f"""
SELECT CASE sold_time_sk // 28800 WHEN 0 THEN 'third' WHEN 1 THEN 'first' ELSE 'second' END AS t_shift,
       {ROWS} AS transactions, {PAID} AS revenue
FROM sale WHERE channel = 'store' GROUP BY ALL"""),
    "d29_stock_by_warehouse": stock("w_warehouse_name, w_state", ON_HAND, "true GROUP BY ALL", PLACE),
    "d29_stock_by_warehouse_latest": stock("w_warehouse_name, w_state", ON_HAND, f"{NEWEST} GROUP BY ALL", PLACE),
    "d30_web_page_type_revenue": over_sales(f"""
SELECT wp_type, {PAID} AS revenue FROM sale JOIN web_page ON wp_web_page_sk = line_number WHERE channel = 'web' GROUP BY ALL"""),
    "d31_recent_runs": with_marts(best(
        f"SELECT backup_type, started_at, status, {size_pretty_sql('size_bytes')} AS pg_size_pretty, duration_secs, notes FROM run_log",
        "started_at DESC NULLS FIRST, id DESC", 10)),
    "d32_hours_since_success": with_marts("""
, good AS (SELECT backup_type, max(started_at) AS last_run FROM run_log WHERE status = 'success' GROUP BY ALL)
SELECT *, CAST(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_run) AS DOUBLE) / CAST(3600000000 AS DOUBLE) AS hours_ago FROM good"""),
}
