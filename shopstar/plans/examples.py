"""The documented example queries of the data-model guides.

Same conventions as :mod:`shopstar.plans.analytics`: facts are reduced on
their join key before meeting a dimension, sums stay exact decimals and
are handed over as double, LIMITs carry a unique tie-break.  Output column
names are those of the documented SQL (lower case).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstar.functions.fmt import size_pretty
from shopstar.functions.numeric import exact_avg, pct, ratio, to_double

AS_OF = _dt.datetime(2024, 2, 1)


def _n():
    return F.count(F.lit(1))


def _by_key(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Pre-aggregate a fact on one join key: row count and exact sum."""
    return df.groupBy(key).agg(_n().alias("n"), F.sum(measure).alias("s"))


# ------------------------------------------------------------------ mart docs
def star_join(m, customer_cols=(), promo_cols=()) -> DataFrame:
    """The universal star-join template (line grain).

    Inner joins to date, item, store; LEFT JOINs to customer and promotion
    keep anonymous and non-promoted sales; they are planned when their
    dimension contributes columns (the registered form uses all five joins).
    The calendar is broadcast and comes last: what the other joins shuffle
    carries the day's key, not its columns.
    """
    f = m.fact_store_sales
    d = F.broadcast(m.dim_date.select("date_sk", "full_date", "year", "month"))   # bounded by days
    i = m.dim_item.select("item_sk", "category", "brand")
    s = m.dim_store.select("store_sk")
    j = f.join(i, f.ss_item_sk == i.item_sk).join(s, f.ss_store_sk == s.store_sk)
    if customer_cols:
        c = m.dim_customer.select("customer_sk", *customer_cols)
        j = j.join(c, j.ss_customer_sk == c.customer_sk, "left")
    if promo_cols:
        p = m.dim_promotion.select("promo_sk", *promo_cols)
        j = j.join(p, j.ss_promo_sk == p.promo_sk, "left")
    j = j.join(d, j.ss_sold_date_sk == d.date_sk)
    return j.select("full_date", "year", "month", "category", "brand", "ss_quantity",
                    to_double("ss_net_paid").alias("ss_net_paid"),
                    to_double("ss_net_profit").alias("ss_net_profit"),
                    *customer_cols, *promo_cols)


def _calendar_rows(fact: DataFrame, date_key: str, m, attrs, measure: str) -> DataFrame:
    """Fact rows joined first to the calendar (bounded by days, broadcast)."""
    f = fact.select(date_key, measure)
    d = F.broadcast(m.dim_date.select("date_sk", *attrs))
    return f.join(d, f[date_key] == d.date_sk)


def monthly_store_revenue(m) -> DataFrame:
    """Store revenue by year and month."""
    j = _calendar_rows(m.fact_store_sales, "ss_sold_date_sk", m, ["year", "month"], "ss_net_paid")
    return (j.groupBy("year", "month").agg(to_double(F.sum("ss_net_paid")).alias("revenue"))
            .orderBy("year", "month"))


def holiday_revenue(m) -> DataFrame:
    """Transactions and revenue on holidays vs other days."""
    j = _calendar_rows(m.fact_store_sales, "ss_sold_date_sk", m, ["is_holiday"], "ss_net_paid")
    return j.groupBy("is_holiday").agg(_n().alias("transactions"), to_double(F.sum("ss_net_paid")).alias("revenue"))


def _store_left_customer(m, attr_expr, name: str) -> DataFrame:
    per_cust = _by_key(m.fact_store_sales, "ss_customer_sk", "ss_net_paid")
    c = m.dim_customer.select("customer_sk", attr_expr.alias(name))
    j = per_cust.join(c, per_cust.ss_customer_sk == c.customer_sk, "left")
    return j


def revenue_by_education(m) -> DataFrame:
    """Revenue and orders by education; unknown customers form the NULL group."""
    j = _store_left_customer(m, F.col("education_status"), "education_status")
    return (j.groupBy("education_status")
            .agg(to_double(F.sum("s")).alias("revenue"), F.sum("n").alias("orders"))
            .orderBy(F.col("revenue").desc_nulls_first()))


def top_customer_states(m, top: int = 10) -> DataFrame:
    """States with the most customers (NULL state is a group)."""
    return (m.dim_customer.groupBy("state").agg(_n().alias("customers"))
            .orderBy(F.col("customers").desc(), F.col("state").asc_nulls_last()).limit(top))


def preferred_revenue(m) -> DataFrame:
    """Preferred vs other customers; unknown flag counts as 'N'."""
    per_cust = _by_key(m.fact_store_sales, "ss_customer_sk", "ss_net_paid")
    c = m.dim_customer.select("customer_sk", "preferred_flag")
    j = per_cust.join(c, per_cust.ss_customer_sk == c.customer_sk, "left")
    return (j.groupBy(F.coalesce("preferred_flag", F.lit("N")).alias("preferred"))
            .agg(to_double(F.sum("s")).alias("revenue")))


def _category_revenue(m, fact: DataFrame, item_key: str, paid: str) -> DataFrame:
    """Revenue per item first, then per category: the join moves one row per item."""
    per = _by_key(fact, item_key, paid)
    i = m.dim_item.select("item_sk", "category")
    return (per.join(i, per[item_key] == i.item_sk)
            .groupBy("category").agg(to_double(F.sum("s")).alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_first()))


def store_category_revenue(m) -> DataFrame:
    """Store revenue by category."""
    return _category_revenue(m, m.fact_store_sales, "ss_item_sk", "ss_net_paid")


def brand_margin(m, top: int = 20) -> DataFrame:
    """Revenue, cost, gross profit and margin by brand (margin base = ext_sales_price)."""
    per = m.fact_store_sales.groupBy("ss_item_sk").agg(
        F.sum("ss_ext_sales_price").alias("rev"), F.sum("ss_ext_wholesale_cost").alias("cost"), F.sum("ss_net_profit").alias("gp"))
    i = m.dim_item.select("item_sk", "brand")
    g = (per.join(i, per.ss_item_sk == i.item_sk).groupBy("brand")
         .agg(F.sum("rev").alias("rev"), F.sum("cost").alias("cost"), F.sum("gp").alias("gp")))
    out = g.select("brand", to_double("rev").alias("revenue"), to_double("cost").alias("cost"),
                   to_double("gp").alias("gross_profit"), to_double(pct("gp", "rev")).alias("margin_pct"), "gp")
    return out.orderBy(F.col("gp").desc_nulls_first(), F.col("brand").asc_nulls_last()).limit(top).drop("gp")


def promoted_vs_not(m) -> DataFrame:
    """Revenue and line items with and without a promotion (no join)."""
    f = m.fact_store_sales
    flag = F.when(F.col("ss_promo_sk").isNull(), "No Promotion").otherwise("Promotion")
    return f.groupBy(flag.alias("promo_flag")).agg(
        to_double(F.sum("ss_net_paid")).alias("revenue"), _n().alias("line_items"))


def _store_by_promo(m) -> DataFrame:
    return _by_key(m.fact_store_sales, "ss_promo_sk", "ss_net_paid")


def promo_channel_effect(m) -> DataFrame:
    """Transactions and revenue by TV x email promotion flags."""
    per = _store_by_promo(m)
    p = m.dim_promotion.select("promo_sk", "channel_tv", "channel_email")
    return (per.join(p, per.ss_promo_sk == p.promo_sk).groupBy("channel_tv", "channel_email")
            .agg(F.sum("n").alias("transactions"), to_double(F.sum("s")).alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_first()))


def roi_by_purpose(m, corrected: bool = False) -> DataFrame:
    """Revenue per promotion cost by purpose.

    Literal form: ``SUM(p.cost)`` runs over sale rows, so each promotion's
    cost is counted once per sale (fan-out).  ``corrected=True`` counts
    each promotion's cost once.  The literal cost sum is ``cost * n`` per
    promotion, computed from the pre-aggregated rows.
    """
    per = _store_by_promo(m)
    p = m.dim_promotion.select("promo_sk", "purpose", "cost")
    j = per.join(p, per.ss_promo_sk == p.promo_sk)
    cost = F.col("cost") if corrected else F.col("cost") * F.col("n").cast("decimal(20,0)")
    g = j.groupBy("purpose").agg(F.sum(cost).alias("promo_cost"), F.sum("s").alias("revenue"))
    return g.select("purpose", to_double("promo_cost").alias("promo_cost"), to_double("revenue").alias("revenue"),
                    to_double(ratio("revenue", "promo_cost")).alias("revenue_per_cost")
                    ).orderBy(F.col("revenue_per_cost").desc_nulls_first())


def store_state_revenue(m) -> DataFrame:
    """Revenue and distinct tickets by store state.

    The store dimension is joined first (planner broadcast when small);
    the distinct ticket count then runs as Spark's two-level aggregate on
    (state, ticket), so no (store, ticket) pre-aggregate is shuffled first.
    """
    f = m.fact_store_sales.select("ss_store_sk", "ss_ticket_number", "ss_net_paid")
    st = m.dim_store.select("store_sk", "state")
    return (f.join(st, f.ss_store_sk == st.store_sk).groupBy("state")
            .agg(to_double(F.sum("ss_net_paid")).alias("revenue"), F.countDistinct("ss_ticket_number").alias("transactions"))
            .orderBy(F.col("revenue").desc_nulls_first()))


def store_size_revenue(m, threshold: int = 200000) -> DataFrame:
    """Large vs small stores by floor space (unknown space counts as small)."""
    per = _by_key(m.fact_store_sales, "ss_store_sk", "ss_net_paid")
    st = m.dim_store.select("store_sk", "floor_space")
    size = F.when(F.col("floor_space") > threshold, "large").otherwise("small")
    return (per.join(st, per.ss_store_sk == st.store_sk).groupBy(size.alias("store_size"))
            .agg(to_double(F.sum("s")).alias("revenue")))


def catalog_category_revenue(m) -> DataFrame:
    """Catalog revenue by category."""
    return _category_revenue(m, m.fact_catalog_sales, "cs_item_sk", "cs_net_paid")


def catalog_promotions(m) -> DataFrame:
    """Catalog line items and revenue by promotion purpose and catalog flag."""
    per = _by_key(m.fact_catalog_sales, "cs_promo_sk", "cs_net_paid")
    p = m.dim_promotion.select("promo_sk", "purpose", "channel_catalog")
    return (per.join(p, per.cs_promo_sk == p.promo_sk).groupBy("purpose", "channel_catalog")
            .agg(F.sum("n").alias("line_items"), to_double(F.sum("s")).alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_first()))


def channel_union_revenue(m) -> DataFrame:
    """Union the three facts, then group by channel."""
    return (m.all_channel_lines("net_paid").groupBy("channel").agg(to_double(F.sum("net_paid")).alias("total_revenue"))
            .orderBy(F.col("total_revenue").desc_nulls_first()))


def top_products(m, top: int = 10) -> DataFrame:
    """Most profitable products (name x category)."""
    per = m.fact_store_sales.groupBy("ss_item_sk").agg(F.sum("ss_net_profit").alias("p"))
    i = m.dim_item.select("item_sk", "product_name", "category")
    g = per.join(i, per.ss_item_sk == i.item_sk).groupBy("product_name", "category").agg(F.sum("p").alias("p"))
    return (g.orderBy(F.col("p").desc_nulls_first(), F.col("product_name").asc_nulls_last(),
                      F.col("category").asc_nulls_last()).limit(top)
            .select("product_name", "category", to_double("p").alias("profit")))


def avg_basket_size(m) -> DataFrame:
    """Average number of lines per ticket (two-level aggregate)."""
    per_ticket = m.fact_store_sales.groupBy("ss_ticket_number").agg(_n().alias("items_per_ticket"))
    g = per_ticket.agg(F.sum("items_per_ticket").cast("decimal(20,0)").alias("items"),
                       F.count("items_per_ticket").cast("decimal(20,0)").alias("tickets"))
    return g.select(to_double(exact_avg("items", "tickets")).alias("avg_basket_size"))


def web_monthly_total(m) -> DataFrame:
    """Web revenue including shipping and tax by month."""
    j = _calendar_rows(m.fact_web_sales, "ws_sold_date_sk", m, ["year", "month"], "ws_net_paid_inc_ship_tax")
    return (j.groupBy("year", "month").agg(to_double(F.sum("ws_net_paid_inc_ship_tax")).alias("total_revenue"))
            .orderBy("year", "month"))


def gift_line_items(m) -> DataFrame:
    """Web lines whose bill and ship customers differ (both known)."""
    f = m.fact_web_sales
    cond = (~F.col("ws_bill_customer_sk").eqNullSafe(F.col("ws_ship_customer_sk"))
            & F.col("ws_bill_customer_sk").isNotNull() & F.col("ws_ship_customer_sk").isNotNull())
    return f.filter(cond).agg(_n().alias("gift_line_items"))


def every_channel(spark, per: DataFrame) -> DataFrame:
    """Three rows, whatever channels ``per`` (one row a channel) holds."""
    names = spark.range(3).select(F.element_at(F.array(F.lit("store"), F.lit("web"), F.lit("catalog")), (F.col("id") + 1).cast("int")).alias("channel"))
    return names.join(per, "channel", "left")


def channel_totals(m) -> DataFrame:
    """Revenue of each fact, a row for each even if it is empty; one pass over the lines."""
    per = m.all_channel_lines("net_paid").groupBy("channel").agg(to_double(F.sum("net_paid")).alias("revenue"))
    return every_channel(per.sparkSession, per)


# --------------------------------------------------------------- staging docs
def catalog_department_revenue(m) -> DataFrame:
    """Catalog revenue by catalogue department."""
    per = _by_key(m.fact_catalog_sales, "cs_catalog_page_sk", "cs_net_paid")
    cp = m.catalog_page
    return (per.join(cp, per.cs_catalog_page_sk == cp.cp_catalog_page_sk).groupBy("cp_department")
            .agg(to_double(F.sum("s")).alias("revenue")).orderBy(F.col("revenue").desc_nulls_first()))


def _item_names(m) -> DataFrame:
    return m.dim_item.select(F.col("item_sk").alias("i_item_sk"), F.col("product_name").alias("i_product_name"),
                             F.col("category").alias("i_category"))


def lowest_current_stock(m, top: int = 20) -> DataFrame:
    """Items with the lowest stock on the latest snapshot date."""
    per = m.inventory_latest.groupBy("inv_item_sk").agg(F.sum("inv_quantity_on_hand").alias("q"))
    i = _item_names(m)
    g = (per.join(i, per.inv_item_sk == i.i_item_sk).groupBy("i_product_name", "i_category")
         .agg(F.sum("q").alias("total_stock")))
    return g.orderBy(F.col("total_stock").asc_nulls_last(), "i_product_name", "i_category").limit(top)


def item_stock_trend(m, item_sk: int = 1) -> DataFrame:
    """Stock of one item per snapshot date and warehouse."""
    inv = m.inventory.filter(F.col("inv_item_sk") == item_sk)
    d = m.dim_date.select(F.col("date_sk"), F.col("full_date").alias("d_date"))
    w = m.warehouse.select("w_warehouse_sk", "w_warehouse_name")
    return (inv.join(F.broadcast(d), inv.inv_date_sk == d.date_sk)
            .join(w, inv.inv_warehouse_sk == w.w_warehouse_sk)
            .select("d_date", "w_warehouse_name", "inv_quantity_on_hand")
            .orderBy("d_date", "w_warehouse_name"))


def low_stock(m, below: int = 10) -> DataFrame:
    """Item x warehouse positions under a threshold on the latest date."""
    cur = m.inventory_latest.filter(F.col("inv_quantity_on_hand") < below)
    i = _item_names(m)
    w = m.warehouse.select("w_warehouse_sk", "w_warehouse_name")
    return (cur.join(i, cur.inv_item_sk == i.i_item_sk).join(w, cur.inv_warehouse_sk == w.w_warehouse_sk)
            .select("i_product_name", "w_warehouse_name", "inv_quantity_on_hand")
            .orderBy("inv_quantity_on_hand"))


def top_return_reasons(m) -> DataFrame:
    """Store returns by cleaned reason text."""
    per = m.store_returns.groupBy("sr_reason_sk").agg(_n().alias("n"))
    r = m.reason.select("r_reason_sk", "r_reason_desc_clean")
    return (per.join(r, per.sr_reason_sk == r.r_reason_sk).groupBy("r_reason_desc_clean")
            .agg(F.sum("n").alias("returns")).orderBy(F.col("returns").desc()))


def return_rate_by_category(m) -> DataFrame:
    """Return rate by category, with the source's LEFT JOIN counting.

    The source counts sale rows *after* joining returns on (ticket, item),
    so a line returned k times counts k returns and k sales.  Both sides are
    reduced to one row per (ticket, item) first; with n sale rows and k
    returns a key contributes ``n*k`` returns and ``n*max(k,1)`` sales,
    which equals the joined row counts without materialising the join.
    """
    s = (m.store_sales.groupBy("ss_ticket_number", "ss_item_sk").agg(F.count("ss_item_sk").alias("ns")))
    r = (m.store_returns.groupBy("sr_ticket_number", "sr_item_sk").agg(F.count("sr_item_sk").alias("nr")))
    j = s.join(r, (s.ss_ticket_number == r.sr_ticket_number) & (s.ss_item_sk == r.sr_item_sk), "left")
    k = F.coalesce(F.col("nr"), F.lit(0))
    per_item = j.groupBy("ss_item_sk").agg(F.sum(F.col("ns") * k).alias("ret"),
                                          F.sum(F.col("ns") * F.greatest(k, F.lit(1))).alias("sal"))
    i = _item_names(m)
    g = (per_item.join(i, per_item.ss_item_sk == i.i_item_sk).groupBy("i_category")
         .agg(F.sum("ret").alias("returns"), F.sum("sal").alias("sales")))
    return g.select("i_category", "returns", "sales",
                    to_double(pct("returns", "sales")).alias("return_rate_pct")
                    ).orderBy(F.col("return_rate_pct").desc_nulls_first())


def sales_by_shift(m) -> DataFrame:
    """Store transactions and revenue by time-of-day shift.

    The time dimension has one row per second of the day (bounded), so it
    is broadcast and joined first; only per-shift partials are shuffled.
    """
    f = m.store_sales.select("ss_sold_time_sk", "ss_net_paid")
    t = F.broadcast(m.time_dim.select("t_time_sk", "t_shift"))
    return (f.join(t, f.ss_sold_time_sk == t.t_time_sk).groupBy("t_shift")
            .agg(_n().alias("transactions"), to_double(F.sum("ss_net_paid")).alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_first()))


def stock_by_warehouse(m, latest_only: bool = False) -> DataFrame:
    """Stock by warehouse.

    Literal form sums the snapshot table across all dates (the source
    does, though stock is semi-additive).  ``latest_only=True`` sums only
    the latest snapshot date.
    """
    inv = m.inventory_latest if latest_only else m.inventory
    per = inv.groupBy("inv_warehouse_sk").agg(F.sum("inv_quantity_on_hand").alias("q"))
    w = m.warehouse.select("w_warehouse_sk", "w_warehouse_name", "w_state")
    return (per.join(w, per.inv_warehouse_sk == w.w_warehouse_sk).groupBy("w_warehouse_name", "w_state")
            .agg(F.sum("q").alias("total_stock")).orderBy(F.col("total_stock").desc_nulls_first()))


def web_page_type_revenue(m) -> DataFrame:
    """Web revenue by page type."""
    per = _by_key(m.fact_web_sales, "ws_web_page_sk", "ws_net_paid")
    wp = m.web_page
    return (per.join(wp, per.ws_web_page_sk == wp.wp_web_page_sk).groupBy("wp_type")
            .agg(to_double(F.sum("s")).alias("revenue")).orderBy(F.col("revenue").desc_nulls_first()))


# ---------------------------------------------------------------- backup guide
def recent_runs(m, top: int = 10) -> DataFrame:
    """Latest run-log entries with a readable size."""
    log = m.run_log
    return (log.orderBy(F.col("started_at").desc_nulls_first(), F.col("id").desc()).limit(top)
            .select("backup_type", "started_at", "status", size_pretty("size_bytes").alias("pg_size_pretty"),
                    "duration_secs", "notes"))


def hours_since_success(m, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """Hours since the last successful run of each type (``as_of`` stands for now())."""
    log = m.run_log.filter(F.col("status") == "success")
    g = log.groupBy("backup_type").agg(F.max("started_at").alias("last_run"))
    now_us = F.unix_micros(F.lit(as_of).cast("timestamp"))
    return g.select("backup_type", "last_run",
                    ((now_us - F.unix_micros(F.col("last_run").cast("timestamp"))) / F.lit(3600_000_000.0))
                    .alias("hours_ago"))


