"""Oracle SQL (DuckDB) of the layout reports."""

from __future__ import annotations

from shopstar.operators.layout import FACT_DATE_KEY, FACT_LOOKUP_KEYS
from shopstar.operators.marts import DIM_KEYS
from shopstar.plans.oracle import julian, with_marts
from shopstar.plans.tables_sql import clean_rows

_FACTS = (("fact_store_sales", "ss"), ("fact_web_sales", "ws"), ("fact_catalog_sales", "cs"))
_RETURNS = (("store", "store_returns", "sr", "ticket", "fact_store_sales", "ss"), ("web", "web_returns", "wr", "order", "fact_web_sales", "ws"),
            ("catalog", "catalog_returns", "cr", "order", "fact_catalog_sales", "cs"))
_PAID = "CAST(sum({c}) AS DOUBLE)"
_START, _END, _STEP, _BACK = "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-01-20'", 7_200_000_000, 21_600_000_000
_STEPS = f"""
, steps AS (SELECT unnest(generate_series({_START}, {_END}, INTERVAL 2 HOUR)) AS step_ts)
, held AS (  -- all samples of the window that ends at a step
  SELECT instance, datname, metric, step_ts, ts, value FROM metrics JOIN steps
  ON epoch_us(ts) > epoch_us(step_ts) - {_BACK} AND epoch_us(ts) <= epoch_us(step_ts))
, deltas AS (
  SELECT instance, datname, metric, ts, value,
         CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END AS delta
  FROM metrics WINDOW w AS (PARTITION BY instance, datname, metric ORDER BY ts, value))
, sums AS (SELECT *, sum(delta) OVER (PARTITION BY instance, datname, metric ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS c FROM deltas)
, rates AS (
  SELECT instance, datname, metric, step_ts,
         CASE WHEN max(epoch_us(ts)) > min(epoch_us(ts))
              THEN CAST(max(c) - min(c) AS DOUBLE) / (CAST(max(epoch_us(ts)) - min(epoch_us(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE)) END AS rate
  FROM sums JOIN steps ON epoch_us(ts) > epoch_us(step_ts) - {_BACK} AND epoch_us(ts) <= epoch_us(step_ts) GROUP BY ALL)"""

SQL = {
    "s15_quarter_revenue": with_marts(" UNION ALL ".join(f"""
SELECT '{t}' AS fact, year, count(*) AS line_items, {_PAID.format(c=p + '_net_paid')} AS revenue
FROM {t} JOIN dim_date ON date_sk = {p}_sold_date_sk WHERE quarter = 4 GROUP BY year""" for t, p in _FACTS)),
    "j06_sale_return_links": with_marts(" UNION ALL ".join(f"""
SELECT '{ch}' AS channel, count(DISTINCT rid) AS returns, count(DISTINCT CASE WHEN f.number IS NOT NULL THEN rid END) AS linked_returns,
       count(f.number) AS linked_pairs, (SELECT CAST(sum({rp}_net_loss) AS DOUBLE) FROM {returns}) AS net_loss
FROM (SELECT *, row_number() OVER () AS rid FROM {returns}) r
LEFT JOIN (SELECT {sp}_{number}_number AS number, {sp}_item_sk AS item FROM {sales}) f ON f.number = {rp}_{number}_number AND f.item = {rp}_item_sk"""
                                                    for ch, returns, rp, number, sales, sp in _RETURNS)),
    "j10_active_promotions": with_marts(f"""
SELECT full_date, count(*) AS active_promotions, CAST(min(p_promo_sk) AS BIGINT) AS first_promo_sk
FROM dim_date JOIN ({clean_rows('promotion')}) p
  ON (p_start_date_sk IS NULL OR date_sk >= p_start_date_sk) AND (p_end_date_sk IS NULL OR date_sk <= p_end_date_sk)
GROUP BY full_date"""),
    "j10_valid_version_sales": with_marts(f"""
SELECT category, count(*) AS line_items, {_PAID.format(c='net_paid')} AS revenue
FROM lines l JOIN dim_item i ON i.item_sk = l.item_sk AND sold_date_sk >= {julian('valid_from')} AND (valid_to IS NULL OR sold_date_sk <= {julian('valid_to')})
GROUP BY category"""),
    "w01_item_profit_ranks": with_marts("""
SELECT item_sk, CAST(profit AS DOUBLE) AS profit, rank() OVER (ORDER BY profit DESC) AS rank FROM (
  SELECT item_sk, sum(profit) AS profit FROM (
    SELECT ss_item_sk AS item_sk, ss_net_profit AS profit FROM fact_store_sales
    UNION ALL SELECT ws_item_sk, ws_net_profit FROM fact_web_sales UNION ALL SELECT cs_item_sk, cs_net_profit FROM fact_catalog_sales) x
  GROUP BY item_sk) y"""),
    "w01_store_revenue_ranks": with_marts("""
SELECT store_sk, state, CAST(revenue AS DOUBLE) AS revenue, rank() OVER (PARTITION BY state ORDER BY revenue DESC) AS rank FROM (
  SELECT store_sk, state, sum(ss_net_paid) AS revenue FROM fact_store_sales JOIN dim_store ON store_sk = ss_store_sk GROUP BY ALL) y"""),
    "s17_best_keys": with_marts(" UNION ALL ".join(f"""
SELECT '{t}' AS fact, '{role}' AS role, CAST({key} AS BIGINT) AS key, count(*) AS line_items, {_PAID.format(c=key[:2] + '_net_paid')} AS revenue
FROM {t} WHERE {key} IS NOT NULL GROUP BY {key} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {key}) = 1"""
                                              for t, keys in FACT_LOOKUP_KEYS.items() for role, key in zip(("item", "customer"), keys, strict=True))),
    "s06_footer_counts": with_marts(" UNION ALL ".join(f"""
SELECT '{t}' AS table_name, count(*) AS rows, CAST(min({k}) AS BIGINT) AS min_key, CAST(max({k}) AS BIGINT) AS max_key FROM {t}"""
                                                  for t, k in (DIM_KEYS | FACT_DATE_KEY).items())),
    "s19_footer_partitions": with_marts(" UNION ALL ".join(f"""
SELECT '{t}' AS table_name, CAST(strftime(DATE '2000-01-01' + (day - 2451545), '%Y%m') AS INTEGER) AS sold_ym, count(*) AS rows,
       CAST(min(day) AS BIGINT) AS min_key, CAST(max(day) AS BIGINT) AS max_key
FROM (SELECT if({p}_{'ticket' if p == 'ss' else 'order'}_number % 13 <> 0, {p}_sold_date_sk, NULL) AS day FROM {t}) GROUP BY 2""" for t, p in _FACTS)),
    "s18_star_join_by_statistics": with_marts(f"""
SELECT year, category, state, count(*) AS line_items, {_PAID.format(c='ss_net_paid')} AS revenue
FROM fact_store_sales JOIN dim_date ON date_sk = ss_sold_date_sk JOIN dim_item ON item_sk = ss_item_sk JOIN dim_store ON store_sk = ss_store_sk
GROUP BY ALL"""),
    "r01_latest_steps": with_marts(_STEPS + """
SELECT instance, datname, metric, step_ts, ts, CAST(value AS DOUBLE) AS value FROM held
QUALIFY row_number() OVER (PARTITION BY instance, datname, metric, step_ts ORDER BY ts DESC, value DESC) = 1"""),
    "r04_rate_steps": with_marts(_STEPS + "\nSELECT * FROM rates"),
    "r06_avg_rate_steps": with_marts(_STEPS + """
SELECT step_ts, round(avg(rate), 6) AS avg_rate, count(*) AS series FROM rates WHERE metric = 'pg_purchase' AND rate IS NOT NULL GROUP BY step_ts"""),
}
