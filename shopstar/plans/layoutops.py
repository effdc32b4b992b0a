"""Reports whose point is the plan: pruned months, bucketed joins, containment joins, full rankings, step grids."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstar.functions.dates import julian_key
from shopstar.functions.numeric import to_double
from shopstar.operators import layout as L
from shopstar.operators import timeseries as R
from shopstar.operators.intervals import containment_join
from shopstar.operators.marts import DIM_KEYS, FACT_TABLES, CatalogMarts, analyze_marts, at_once, staged_lines
from shopstar.operators.ranking import rank_rows
from shopstar.session import shared_path

BUCKETS = 8
# The events lie hours apart, so steps and windows are hours, not the dashboard's 15 seconds and 5 minutes.
GRID = (_dt.datetime(2024, 1, 10), _dt.datetime(2024, 1, 20))
STEP_S, LOOKBACK_S = 2 * 3600, 6 * 3600


def _n():
    return F.count(F.lit(1))


def quarter_of_written_facts(facts: dict[str, DataFrame], calendar: DataFrame, quarter: int = 4) -> DataFrame:
    """Revenue of one quarter per channel and year; on written facts only the quarter's months are read."""
    days = calendar.where(F.col("quarter") == quarter)
    days = days.select("date_sk", "year", *[c for c in (L.PARTITION_COL,) if c in days.columns])
    out = None
    for t, key in L.FACT_DATE_KEY.items():
        per = L.join_calendar(facts[t], days, key).groupBy("year").agg(_n().alias("line_items"), to_double(F.sum(f"{key[:2]}_net_paid")).alias("revenue"))
        per = per.select(F.lit(t).alias("fact"), "year", "line_items", "revenue")
        out = per if out is None else out.unionByName(per)
    return out


def quarter_revenue(m) -> DataFrame:
    """The facts written by month, then the last quarter of every year read from them."""
    folder = shared_path(m.spark, "layoutops", uuid.uuid4().hex)
    _write_facts(m, folder)
    facts = {t: L.read_fact(m.spark, f"{folder}/{t}") for t in L.FACT_DATE_KEY}
    return quarter_of_written_facts(facts, m.dim_date)


def sale_return_links(m, tag: str | None = None) -> DataFrame:
    """Sales and returns in bucketed tables, linked by channel, number and item without an exchange.

    The tables stay below the shared folder under names of their own, as the result reads them.
    """
    tag, keys = tag or uuid.uuid4().hex[:12], ["channel", "order_number", "item_sk"]
    folder = shared_path(m.spark, "layoutops", tag)
    sales = L.write_bucketed(m.all_channel_lines("order_number", "net_paid").select(*keys, "net_paid"), f"linked_sales_{tag}", f"{folder}/sales", keys, BUCKETS)
    returns = L.write_bucketed(m.all_returns().select(*keys, "net_loss"), f"linked_returns_{tag}", f"{folder}/returns", keys, BUCKETS)
    # both sides are reduced to one row a link key first: no pair of repeated lines is made
    sold = sales.groupBy(*keys).agg(_n().alias("lines"), F.sum("net_paid").alias("paid"))
    back = returns.groupBy(*keys).agg(_n().alias("returns"), F.sum("net_loss").alias("net_loss"))
    j = back.join(sold, keys, "left")
    return j.groupBy("channel").agg(
        F.sum("returns").alias("returns"), F.sum(F.when(F.col("lines").isNotNull(), F.col("returns")).otherwise(0)).alias("linked_returns"),
        F.sum(F.coalesce(F.col("returns") * F.col("lines"), F.lit(0))).alias("linked_pairs"), to_double(F.sum("net_loss")).alias("net_loss"))


def active_promotions(m) -> DataFrame:
    """Promotions whose validity holds the day, for every day that has one."""
    p = m.promotion.select("p_promo_sk", "p_start_date_sk", "p_end_date_sk")
    held = containment_join(m.dim_date.select("date_sk", "full_date"), p, "date_sk", "p_start_date_sk", "p_end_date_sk", width=32)
    return held.groupBy("full_date").agg(_n().alias("active_promotions"), F.min("p_promo_sk").cast("bigint").alias("first_promo_sk"))


def valid_version_sales(m) -> DataFrame:
    """Sales by the item version that was valid on the sale date, all channels."""
    per = m.all_channel_lines("net_paid").groupBy("item_sk", "sold_date_sk").agg(_n().alias("n"), F.sum("net_paid").alias("s"))
    versions = m.dim_item.select("item_sk", "category", julian_key("valid_from").alias("from_sk"), julian_key("valid_to").alias("to_sk"))
    held = containment_join(per, versions, "sold_date_sk", "from_sk", "to_sk", ["item_sk"], width=1024)
    return held.groupBy("category").agg(F.sum("n").alias("line_items"), to_double(F.sum("s")).alias("revenue"))


def item_profit_ranks(m) -> DataFrame:
    """Every item's rank by profit over all channels (RANK: ties share one), without a single-task window."""
    per = m.all_channel_lines("net_profit").groupBy("item_sk").agg(F.sum("net_profit").alias("profit"))
    return rank_rows(per, [("profit", True)]).select("item_sk", to_double("profit").alias("profit"), F.col("rank").cast("bigint").alias("rank"))


def store_revenue_ranks(m) -> DataFrame:
    """Every store's rank by revenue within its state."""
    per = m.fact_store_sales.groupBy("ss_store_sk").agg(F.sum("ss_net_paid").alias("revenue"))
    s = m.dim_store.select("store_sk", "state")
    rows = per.join(s, per.ss_store_sk == s.store_sk).select("store_sk", "state", "revenue")
    return rank_rows(rows, [("revenue", True)], ["state"]).select("store_sk", "state", to_double("revenue").alias("revenue"), F.col("rank").cast("bigint").alias("rank"))


def latest_steps(m) -> DataFrame:
    """R01 on a step grid: the latest sample of each series at every step, if it is not stale."""
    steps = R.latest_at_steps(m.metrics, *GRID, STEP_S, LOOKBACK_S)
    return steps.withColumn("value", F.col("value").cast("double"))


def rate_steps(m) -> DataFrame:
    """R04 on a step grid."""
    return R.rate_at_steps(m.metrics, *GRID, STEP_S, LOOKBACK_S)


def avg_rate_steps(m) -> DataFrame:
    """R06 on a step grid: the average purchase rate across series at every step."""
    return R.avg_at_steps(R.rate_at_steps(m.metrics, *GRID, STEP_S, LOOKBACK_S, metric="pg_purchase"), "rate")


def best_keys(m) -> DataFrame:
    """The facts in Z-order of item and customer; the lines of each fact's most frequent item and customer, looked up."""
    folder, out = shared_path(m.spark, "layoutops", uuid.uuid4().hex), None
    with staged_lines(m, folder) as lines:
        at_once(lambda t: L.write_clustered(getattr(lines, t), f"{folder}/{t}", L.FACT_DATE_KEY[t], L.FACT_LOOKUP_KEYS[t]), FACT_TABLES)
    for t, date_key in L.FACT_DATE_KEY.items():
        fact = L.read_fact(m.spark, f"{folder}/{t}")
        for role, key in zip(("item", "customer"), L.FACT_LOOKUP_KEYS[t], strict=True):
            best = fact.where(F.col(key).isNotNull()).groupBy(key).agg(_n().alias("n")).orderBy(F.desc("n"), key).first()
            if best is None:  # no line has such a key
                continue
            found = fact.where(F.col(key) == best[0]).agg(_n().alias("line_items"), to_double(F.sum(f"{date_key[:2]}_net_paid")).alias("revenue"))
            row = found.select(F.lit(t).alias("fact"), F.lit(role).alias("role"), F.lit(best[0]).cast("bigint").alias("key"), "line_items", "revenue")
            out = row if out is None else out.unionByName(row)
    return out if out is not None else m.spark.createDataFrame([], "fact string, role string, key bigint, line_items bigint, revenue double")


def _write_facts(m, folder: str) -> None:
    """The facts by month below ``folder``; their lines are joined once."""
    with staged_lines(m, folder) as lines:
        at_once(lambda t: L.write_fact(getattr(lines, t), f"{folder}/{t}", L.FACT_DATE_KEY[t]), FACT_TABLES)


def _written(m) -> str:
    """All marts written below the shared folder, the facts by month."""
    folder = shared_path(m.spark, "layoutops", uuid.uuid4().hex)
    _write_facts(m, folder)
    for t in DIM_KEYS:
        getattr(m, t).write.parquet(f"{folder}/{t}")
    return folder


def _collected(m, frames: dict[str, DataFrame], schema: str) -> DataFrame:
    """Small reports (a row a table or month) of another session as one frame of this session."""
    return m.spark.createDataFrame([(t, *r) for t, df in frames.items() for r in df.collect()], schema)


def footer_row_counts(m) -> DataFrame:
    """Rows and key range of all eight marts, from Parquet footers."""
    folder = _written(m)
    keys = {**DIM_KEYS, **L.FACT_DATE_KEY}
    return _collected(m, {t: L.footer_counts(m.spark, f"{folder}/{t}", k) for t, k in keys.items()},
                      "table_name string, rows bigint, min_key bigint, max_key bigint")


def footer_partitions(m) -> DataFrame:
    """Rows and date range of every month of the three facts, from Parquet footers; every 13th line has no date here."""
    folder, out = shared_path(m.spark, "layoutops", uuid.uuid4().hex), {}
    with staged_lines(m, folder) as lines:
        def write(t):
            key = L.FACT_DATE_KEY[t]
            number = f"{key[:2]}_{'ticket' if t == 'fact_store_sales' else 'order'}_number"
            L.write_fact(getattr(lines, t).withColumn(key, F.when(F.col(number) % 13 != 0, F.col(key))), f"{folder}/{t}", key)
        at_once(write, FACT_TABLES)
    for t, key in L.FACT_DATE_KEY.items():
        out[t] = L.footer_counts(m.spark, f"{folder}/{t}", key, by_month=True).select(L.PARTITION_COL, "rows", "min_key", "max_key")
    return _collected(m, out, "table_name string, sold_ym int, rows bigint, min_key bigint, max_key bigint")


def star_join_by_statistics(m) -> DataFrame:
    """Store revenue by category and state on analysed catalog tables; the planner orders the joins by statistics.

    The tables stay in a database of their own, as the result reads them.
    """
    database = f"layoutops_{uuid.uuid4().hex[:12]}"
    analyze_marts(m.spark, _written(m), database)
    c = CatalogMarts(m.spark, database)
    f, d, i, s = c.fact_store_sales, c.dim_date, c.dim_item, c.dim_store
    return (f.join(d, f.ss_sold_date_sk == d.date_sk).join(i, f.ss_item_sk == i.item_sk).join(s, f.ss_store_sk == s.store_sk)
            .groupBy(d.year, i.category, s.state).agg(_n().alias("line_items"), to_double(F.sum("ss_net_paid")).alias("revenue")))


def registry(on):
    return {
        "s15_quarter_revenue": on(quarter_revenue), "j06_sale_return_links": on(sale_return_links),
        "j10_active_promotions": on(active_promotions), "j10_valid_version_sales": on(valid_version_sales),
        "w01_item_profit_ranks": on(item_profit_ranks), "w01_store_revenue_ranks": on(store_revenue_ranks),
        "s17_best_keys": on(best_keys), "s06_footer_counts": on(footer_row_counts), "s19_footer_partitions": on(footer_partitions),
        "s18_star_join_by_statistics": on(star_join_by_statistics),
        "r01_latest_steps": on(latest_steps), "r04_rate_steps": on(rate_steps), "r06_avg_rate_steps": on(avg_rate_steps),
    }
