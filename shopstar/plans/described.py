"""Computations the data-model guides describe in words (N01-N20) and the
advertised cross-tab (G14), as DataFrame functions over the marts."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstar.functions.dates import days_between_keys, safe_make_date
from shopstar.functions.numeric import exact_avg, pct, ratio, to_double
from shopstar.plans.examples import every_channel

CHANNELS = ["store", "web", "catalog"]
AGE_AS_OF = _dt.date(2002, 1, 1)


def _n():
    return F.count(F.lit(1))


def fulfilment_lag(m) -> DataFrame:
    """Distribution of days from sale to shipment (web, catalog; staging keys).

    Days are taken through the calendar dates (the keys are Julian days,
    so the difference of keys is the same number).
    """
    out = None
    for ch, f, p in (("web", m.web_sales, "ws"), ("catalog", m.catalog_sales, "cs")):
        lag = days_between_keys(f"{p}_ship_date_sk", f"{p}_sold_date_sk")
        g = f.groupBy(lag.alias("lag_days")).agg(_n().alias("line_items")).select(F.lit(ch).alias("channel"), "*")
        out = g if out is None else out.unionByName(g)
    return out


def _remote_by(m, key_suffix: str, measure: str = "net_paid") -> DataFrame:
    parts = []
    for ch, f, p in (("web", m.web_sales, "ws"), ("catalog", m.catalog_sales, "cs")):
        parts.append(f.groupBy(F.col(f"{p}_{key_suffix}").alias("k"))
                     .agg(_n().alias("n"), F.sum(f"{p}_{measure}").alias("s"))
                     .select(F.lit(ch).alias("channel"), "*"))
    return parts[0].unionByName(parts[1])


def revenue_by_ship_mode(m) -> DataFrame:
    """Web and catalog revenue by ship mode."""
    per = _remote_by(m, "ship_mode_sk")
    sm = m.ship_mode
    return (per.join(sm, per.k == sm.sm_ship_mode_sk).groupBy("channel", "sm_type")
            .agg(F.sum("n").alias("line_items"), to_double(F.sum("s")).alias("revenue")))


def revenue_by_warehouse(m) -> DataFrame:
    """Web and catalog revenue by fulfilling warehouse."""
    per = _remote_by(m, "warehouse_sk")
    w = m.warehouse.select("w_warehouse_sk", "w_warehouse_name")
    return (per.join(w, per.k == w.w_warehouse_sk).groupBy("channel", "w_warehouse_name")
            .agg(F.sum("n").alias("line_items"), to_double(F.sum("s")).alias("revenue")))


def payer_vs_recipient(m) -> DataFrame:
    """Catalog revenue by the payer's and the recipient's demographics (one table in two roles)."""
    f = m.catalog_sales
    per = f.groupBy("cs_bill_cdemo_sk", "cs_ship_cdemo_sk").agg(_n().alias("n"), F.sum("cs_net_paid").alias("s"))
    cd = m.customer_demographics
    bill = cd.select(F.col("cd_demo_sk").alias("b_sk"), F.col("cd_education_status").alias("bill_education"), F.col("cd_gender").alias("bill_gender"))
    ship = cd.select(F.col("cd_demo_sk").alias("s_sk"), F.col("cd_education_status").alias("ship_education"), F.col("cd_gender").alias("ship_gender"))
    j = per.join(bill, per.cs_bill_cdemo_sk == bill.b_sk).join(ship, per.cs_ship_cdemo_sk == ship.s_sk)
    return (j.groupBy("bill_education", "bill_gender", "ship_education", "ship_gender")
            .agg(F.sum("n").alias("line_items"), to_double(F.sum("s")).alias("revenue")))


def gift_share_by_year(m) -> DataFrame:
    """Web lines that go to another address than the payer's, per year."""
    f = m.web_sales
    gift = (F.col("ws_bill_addr_sk") != F.col("ws_ship_addr_sk"))  # NULL, so no gift, where an address is unknown
    d = F.broadcast(m.dim_date.select("date_sk", "year"))
    rows = f.select("ws_sold_date_sk", gift.alias("is_gift"))
    g = rows.join(d, rows.ws_sold_date_sk == d.date_sk).groupBy("year").agg(
        _n().alias("line_items"), F.count(F.when(F.col("is_gift"), 1)).alias("gift_line_items"))
    return g.select("year", "line_items", "gift_line_items",
                    to_double(pct("gift_line_items", "line_items")).alias("gift_pct"))


def promotion_activity(m) -> DataFrame:
    """Store sales inside their promotion's active window, and on its own item.

    The promotion's validity is an interval [start, end] of date keys:
    equi-join on the promotion key plus a containment predicate.
    """
    f = m.fact_store_sales
    per = f.groupBy("ss_promo_sk", "ss_sold_date_sk", "ss_item_sk").agg(_n().alias("n"))
    p = m.promotion.select(F.col("p_promo_sk").alias("promo_sk"), F.col("p_promo_name").alias("promo_name"),
                           F.col("p_start_date_sk").alias("start_date_sk"), F.col("p_end_date_sk").alias("end_date_sk"),
                           F.col("p_item_sk").alias("item_sk"))
    j = per.join(p, per.ss_promo_sk == p.promo_sk)
    active = F.col("ss_sold_date_sk").between(F.col("start_date_sk"), F.col("end_date_sk"))
    return j.groupBy("promo_name").agg(
        F.sum("n").alias("line_items"),
        F.sum(F.when(active, F.col("n")).otherwise(0)).alias("in_window_line_items"),
        F.sum(F.when(F.col("ss_item_sk") == F.col("item_sk"), F.col("n")).otherwise(0)).alias("item_specific_line_items"))


def buyer_income_band(m) -> DataFrame:
    """Store revenue by the buyer household's income band (sale -> household -> band)."""
    per = m.store_sales.groupBy("ss_hdemo_sk").agg(_n().alias("n"), F.sum("ss_net_paid").alias("s"))
    hd = m.household_demographics
    ib = m.income_band
    j = (per.join(hd, per.ss_hdemo_sk == hd.hd_demo_sk)
         .join(ib, F.col("hd_income_band_sk") == ib.ib_income_band_sk))
    return (j.groupBy("ib_lower_bound", "ib_upper_bound")
            .agg(F.sum("n").alias("line_items"), to_double(F.sum("s")).alias("revenue")))


def customer_age_bands(m, as_of: _dt.date = AGE_AS_OF) -> DataFrame:
    """Birth date from its parts (NULL if impossible) and age band at ``as_of``."""
    c = m.customer
    born = safe_make_date("c_birth_year", "c_birth_month", "c_birth_day")
    before_birthday = (F.lit(as_of.month) < F.month(born)) | (
        (F.lit(as_of.month) == F.month(born)) & (F.lit(as_of.day) < F.dayofmonth(born)))
    age = F.lit(as_of.year) - F.year(born) - F.when(before_birthday, 1).otherwise(0)
    band = (F.when(born.isNull(), "unknown").when(age < 30, "under 30").when(age < 45, "30-44")
            .when(age < 60, "45-59").otherwise("60+"))
    return c.groupBy(band.alias("age_band")).agg(_n().alias("customers"))


def current_versions(m) -> DataFrame:
    """Open stores (no close date) and current item versions (no end date)."""
    s = m.store.agg(_n().alias("total_rows"), F.count(F.when(F.col("s_closed_date_sk").isNull(), 1)).alias("current_rows"))
    i = m.dim_item.agg(_n().alias("total_rows"), F.count(F.when(F.col("valid_to").isNull(), 1)).alias("current_rows"))
    return (s.select(F.lit("store").alias("entity"), "current_rows", "total_rows")
            .unionByName(i.select(F.lit("item").alias("entity"), "current_rows", "total_rows")))


def item_gross_margin(m) -> DataFrame:
    """Gross margin per item version (price - wholesale cost) and margin %."""
    i = m.dim_item
    return i.select("item_sk", "item_id",
                    to_double(F.col("current_price") - F.col("wholesale_cost")).alias("gross_margin"),
                    to_double(pct(F.col("current_price") - F.col("wholesale_cost"), "current_price")).alias("margin_pct"))


def promo_cost_per_transaction(m) -> DataFrame:
    """Promotion cost divided by the store transactions it drove."""
    per = m.fact_store_sales.groupBy("ss_promo_sk").agg(_n().alias("transactions"))
    p = m.dim_promotion.select("promo_sk", "promo_name", "cost")
    j = per.join(p, per.ss_promo_sk == p.promo_sk)
    return j.select("promo_name", "transactions", to_double("cost").alias("cost"),
                    to_double(ratio("cost", F.col("transactions").cast("decimal(20,0)"))).alias("cost_per_transaction"))


def same_day_last_year(m) -> DataFrame:
    """Daily store revenue next to the same day of last year and of last quarter (precomputed key links)."""
    per = m.fact_store_sales.groupBy("ss_sold_date_sk").agg(F.sum("ss_net_paid").alias("s"))
    d = F.broadcast(m.date_dim.select("d_date_sk", "d_date", "d_same_day_ly", "d_same_day_lq"))  # one row a day
    cur = per.join(d, per.ss_sold_date_sk == d.d_date_sk)
    ly = per.select(F.col("ss_sold_date_sk").alias("ly_sk"), F.col("s").alias("s_ly"))
    lq = per.select(F.col("ss_sold_date_sk").alias("lq_sk"), F.col("s").alias("s_lq"))
    j = cur.join(ly, cur.d_same_day_ly == ly.ly_sk, "left").join(lq, cur.d_same_day_lq == lq.lq_sk, "left")
    return j.select(F.col("d_date").alias("full_date"), to_double("s").alias("revenue"),
                    to_double("s_ly").alias("revenue_same_day_ly"), to_double("s_lq").alias("revenue_same_day_lq"))


def sale_time_profile(m) -> DataFrame:
    """Store revenue by the buyer's demographics, household and address recorded with the sale.

    The line items are reduced per recorded key triple first; a key without a row of its table counts as unknown.
    """
    per = m.store_sales.groupBy("ss_cdemo_sk", "ss_hdemo_sk", "ss_addr_sk").agg(_n().alias("n"), F.sum("ss_net_paid").alias("s"))
    cd = m.customer_demographics.select("cd_demo_sk", "cd_education_status")
    hd = m.household_demographics.select("hd_demo_sk", "hd_income_band_sk")
    ca = m.customer_address.select("ca_address_sk", "ca_state")
    j = (per.join(ca, per.ss_addr_sk == ca.ca_address_sk, "left").join(hd, per.ss_hdemo_sk == hd.hd_demo_sk, "left")
         .join(cd, per.ss_cdemo_sk == cd.cd_demo_sk, "left"))
    return (j.groupBy("cd_education_status", "hd_income_band_sk", "ca_state")
            .agg(F.sum("n").alias("line_items"), to_double(F.sum("s")).alias("revenue")))


def basket_by_channel(m) -> DataFrame:
    """Receipts per channel, average lines and average value per receipt (one pass over the lines)."""
    lines = m.all_channel_lines("order_number", "net_paid")
    per = lines.groupBy("channel", "order_number").agg(_n().alias("lines"), F.sum("net_paid").alias("value"))
    g = per.groupBy("channel").agg(_n().alias("receipts"), F.sum("lines").cast("decimal(20,0)").alias("lines"),
                                   F.sum("value").alias("value"), F.count("value").alias("n_value"))
    g = g.select("channel", "receipts", to_double(exact_avg("lines", "receipts")).alias("avg_lines"),
                 to_double(exact_avg("value", "n_value")).alias("avg_receipt_value"))
    return every_channel(g.sparkSession, g).fillna(0, ["receipts"])


def return_match(m) -> DataFrame:
    """Returns per channel, those matching a sale on (number, item), and net loss."""
    # distinct sale keys: the LEFT JOIN then cannot multiply return rows
    keys = m.all_channel_lines("order_number").select("channel", "order_number", "item_sk").distinct().withColumn("sold", F.lit(1))
    g = (m.all_returns().join(keys, ["channel", "order_number", "item_sk"], "left").groupBy("channel")
         .agg(_n().alias("returns"), F.count("sold").alias("matched_returns"), to_double(F.sum("net_loss")).alias("net_loss")))
    return every_channel(g.sparkSession, g).fillna(0, ["returns", "matched_returns"])


def refund_mismatch(m) -> DataFrame:
    """web/catalog returns refunded to someone other than the returner."""
    out = None
    for ch, r, p in (("web", m.web_returns, "wr"), ("catalog", m.catalog_returns, "cr")):
        diff = ~F.col(f"{p}_refunded_customer_sk").eqNullSafe(F.col(f"{p}_returning_customer_sk"))
        g = r.agg(_n().alias("returns"), F.count(F.when(diff, 1)).alias("mismatched"))
        g = g.select(F.lit(ch).alias("channel"), "returns", "mismatched")
        out = g if out is None else out.unionByName(g)
    return out


def money_identity_check(m) -> DataFrame:
    """Rows per channel that break the documented money identities (one pass over the lines).

    net_paid = ext_sales_price - coupon_amt; ext_sales_price = ext_list_price
    - ext_discount_amt; net_paid_inc_tax = net_paid + ext_tax; net_profit =
    net_paid - ext_wholesale_cost (web/catalog: minus ext_ship_cost too).
    """
    lines = m.all_channel_lines("net_paid", "ext_sales_price", "coupon_amt", "ext_list_price", "ext_discount_amt", "net_paid_inc_tax",
                                "ext_tax", "net_profit", "ext_wholesale_cost", "ext_ship_cost")
    c = F.col
    shipping = F.when(c("channel") != "store", c("ext_ship_cost")).otherwise(F.lit(0))
    checks = {
        "bad_net_paid": c("net_paid") != c("ext_sales_price") - c("coupon_amt"),
        "bad_sales_price": c("ext_sales_price") != c("ext_list_price") - c("ext_discount_amt"),
        "bad_inc_tax": c("net_paid_inc_tax") != c("net_paid") + c("ext_tax"),
        "bad_profit": c("net_profit") != c("net_paid") - c("ext_wholesale_cost") - shipping,
    }
    g = lines.groupBy("channel").agg(_n().alias("line_items"), *[F.count(F.when(v, 1)).alias(k) for k, v in checks.items()])
    return every_channel(g.sparkSession, g).fillna(0, ["line_items", *checks])


def call_center_revenue(m) -> DataFrame:
    """Catalog revenue attributed to call centres."""
    per = m.fact_catalog_sales.groupBy("cs_call_center_sk").agg(_n().alias("n"), F.sum("cs_net_paid").alias("s"))
    cc = m.call_center
    return (per.join(cc, per.cs_call_center_sk == cc.cc_call_center_sk)
            .select("cc_name", F.col("n").alias("line_items"), to_double("s").alias("revenue")))


def corporate_revenue(m) -> DataFrame:
    """Store revenue by division and company."""
    per = m.fact_store_sales.groupBy("ss_store_sk").agg(F.sum("ss_net_paid").alias("s"))
    st = m.store.select(F.col("s_store_sk").alias("store_sk"), F.col("s_division_name").alias("division_name"),
                        F.col("s_company_name").alias("company_name"))
    return (per.join(st, per.ss_store_sk == st.store_sk).groupBy("division_name", "company_name")
            .agg(to_double(F.sum("s")).alias("revenue")))


def local_sale_hour(m) -> DataFrame:
    """Store lines by local hour of sale (customer's GMT offset applied).

    Offsets are fixed per customer, so the local hour depends only on the
    UTC minute of the day: lines are reduced to (customer, minute) before
    the customer join, which bounds the join input by customers x 1440.
    """
    f = m.fact_store_sales.filter(F.col("ss_customer_sk").isNotNull())
    per = f.groupBy("ss_customer_sk", (F.col("ss_sold_time_sk") / 60).cast("int").alias("utc_minute")) \
        .agg(_n().alias("n"))
    c = m.dim_customer.select("customer_sk", "gmt_offset")
    j = per.join(c, per.ss_customer_sk == c.customer_sk)
    local_minute = F.pmod(F.col("utc_minute") + (F.col("gmt_offset") * 60).cast("int"), F.lit(1440))
    return j.groupBy((local_minute / 60).cast("int").alias("local_hour")).agg(F.sum("n").alias("line_items"))


def items_by_manager(m) -> DataFrame:
    """Items and categories per category manager."""
    per = m.item.groupBy("i_manager_id", "i_category").agg(_n().alias("n"))
    return (per.groupBy(F.col("i_manager_id").alias("manager_id"))
            .agg(F.sum("n").alias("items"), F.count("i_category").alias("categories")))


def channel_pivot(m) -> DataFrame:
    """Cross-tab of yearly revenue by channel (explicit pivot values)."""
    lines = m.all_channel_lines("net_paid")
    d = F.broadcast(m.dim_date.select("date_sk", "year"))
    p = (lines.join(d, lines.sold_date_sk == d.date_sk).groupBy("year").pivot("channel", CHANNELS)
         .agg(F.sum("net_paid")))
    return p.select("year", *[to_double(ch).alias(ch) for ch in CHANNELS])


def registry(on):
    return {
        "n01_fulfilment_lag": on(fulfilment_lag),
        "n02_revenue_by_ship_mode": on(revenue_by_ship_mode),
        "n02_revenue_by_warehouse": on(revenue_by_warehouse),
        "n03_payer_vs_recipient": on(payer_vs_recipient),
        "n04_gift_share_by_year": on(gift_share_by_year),
        "n05_promotion_activity": on(promotion_activity),
        "n06_buyer_income_band": on(buyer_income_band),
        "n07_customer_age_bands": on(customer_age_bands),
        "n08_current_versions": on(current_versions),
        "n09_item_gross_margin": on(item_gross_margin),
        "n10_promo_cost_per_transaction": on(promo_cost_per_transaction),
        "n11_same_day_last_year": on(same_day_last_year),
        "n12_sale_time_profile": on(sale_time_profile),
        "n13_basket_by_channel": on(basket_by_channel),
        "n14_return_match": on(return_match),
        "n15_refund_mismatch": on(refund_mismatch),
        "n16_money_identity_check": on(money_identity_check),
        "n17_call_center_revenue": on(call_center_revenue),
        "n18_corporate_revenue": on(corporate_revenue),
        "n19_local_sale_hour": on(local_sale_hour),
        "n20_items_by_manager": on(items_by_manager),
        "g14_channel_pivot": on(channel_pivot),
    }
