"""FIXTURES.md edge rows on hand-made marts: holiday on a weekend, zero-sum and all-NULL groups,
rank ties, a year without web rows, a gap month, gift lines."""
import datetime as dt
from decimal import Decimal as Dm

import pytest

from shopstar.operators.marts import MartFrames
from shopstar.plans import analytics as A
from shopstar.plans import examples as D

FACT = ("ss_sold_date_sk int, ss_item_sk int, ss_customer_sk int, ss_store_sk int, ss_promo_sk int, "
        "ss_ticket_number bigint, ss_net_paid decimal(7,2), ss_net_profit decimal(7,2), ss_ext_discount_amt decimal(7,2)")
REMOTE = "{p}_sold_date_sk int, {p}_item_sk int, {p}_net_paid decimal(7,2), {p}_net_profit decimal(7,2)"
DATE = "date_sk int, full_date date, year int, month int, is_holiday boolean, is_weekend boolean"


def jk(d):
    return (d - dt.date(2000, 1, 1)).days + 2451545


@pytest.fixture(scope="module")
def m(spark):
    days = [dt.date(1999, 1, 1), dt.date(1999, 3, 6), dt.date(1999, 3, 8), dt.date(2000, 7, 4), dt.date(2000, 7, 5),
            dt.date(2001, 12, 25)]
    dim_date = spark.createDataFrame(
        [(jk(d), d, d.year, d.month, (d.month, d.day) in {(1, 1), (7, 4), (12, 25)}, d.weekday() >= 5) for d in days],
        DATE)
    store = [
        (jk(days[0]), 1, 1, 1, None, 1, Dm("10.00"), Dm("5.00"), Dm("0")),        # 1999-01-01: holiday on a Friday
        (jk(days[1]), 2, 2, 2, None, 2, Dm("20.00"), Dm("5.00"), Dm("0")),        # 1999-03-06: Saturday
        (jk(days[2]), 3, None, 1, None, 3, Dm("-7.00"), Dm("1.00"), Dm("0")),     # category C sums to 0 ...
        (jk(days[2]), 3, None, 2, None, 4, Dm("7.00"), Dm("1.00"), Dm("0")),      # ... over two rows
        (jk(days[3]), 4, None, 4, None, 5, None, None, Dm("0")),                  # all-NULL amounts (item 4, store 4)
        (jk(days[5]), 1, 1, 3, None, 6, Dm("30.00"), Dm("-2.00"), Dm("0")),       # 2001-12-25: holiday on Tuesday
    ]
    web = [(jk(days[0]), 1, Dm("3.00"), Dm("1.00")), (jk(days[5]), 1, Dm("4.00"), Dm("1.00"))]   # no 2000 web rows
    cat = [(jk(d), 2, Dm("1.00"), Dm("0.10")) for d in days]
    item = spark.createDataFrame([(1, "A", "b1"), (2, "B", "b2"), (3, "C", "b3"), (4, "D", None)],
                                 "item_sk int, category string, brand string")
    dim_store = spark.createDataFrame([(1, "one", "x", "s"), (2, "two", "y", "s"), (3, "three", "z", "s"),
                                       (4, "four", "w", "s")],
                                      "store_sk int, store_name string, city string, state string")
    return MartFrames({
        "dim_date": dim_date, "dim_item": item, "dim_store": dim_store,
        "fact_store_sales": spark.createDataFrame(store, FACT),
        "fact_web_sales": spark.createDataFrame(web, REMOTE.format(p="ws")),
        "fact_catalog_sales": spark.createDataFrame(cat, REMOTE.format(p="cs")),
    })


def test_holiday_wins_over_weekend_and_days_with_sales_only(m):
    got = {r.day_type: (r.days, r.total_transactions) for r in A.holiday_lift(m, years=(1999, 2001)).collect()}
    assert got == {"Holiday": (3, 3), "Weekend": (1, 1), "Regular weekday": (1, 2)}


def test_zero_sum_and_all_null_groups(m):
    got = {r.category: (r.net_paid_m, r.profit_margin_pct) for r in A.top_categories(m).collect()}
    assert got["C"] == (0.0, None)            # NULLIF(sum, 0) -> NULL margin
    assert got["D"] == (None, None)           # all amounts NULL -> NULL sums


def test_rank_ties_share_a_rank_with_a_gap(m):
    rows = A.store_ranking(m, top=4).collect()
    # store 4 has only NULL profit (first: NULLs first on DESC); stores 1 and 2 tie at 6.00; store 3 at -2.00
    assert [(r.store_sk, r.profit_rank) for r in rows] == [(4, 1), (1, 2), (2, 2), (3, 4)]
    top2 = [(r.store_sk, r.profit_rank) for r in A.store_ranking(m, top=2).collect()]
    assert top2 == [(4, 1), (1, 2)]          # the tie is cut by the store key, ranks stay global


def test_year_without_web_rows(m):
    got = {r.year: r for r in A.channel_revenue(m, years=(1999, 2001)).collect()}
    assert got[2000].web_net_paid_m is None and got[2000].total_net_paid_m is None
    assert got[1999].web_net_paid_m == 0.0
    lit = {r.year: r for r in A.channel_revenue(m, years=(1999, 2001), literal=True).collect()}
    assert lit[2000].web_net_paid_m is None
    growth = {r.year: r for r in A.channel_growth(m, years=(1999, 2001)).collect()}
    assert growth[1999].store_yoy_pct is None and growth[2001].web_yoy_pct is None   # previous year NULL


def test_gap_month_moving_average_counts_rows(m):
    rows = A.monthly_trend(m, years=(1999, 2001)).collect()
    assert [(r.year, r.month) for r in rows] == [(1999, 1), (1999, 3), (2000, 7), (2001, 12)]


def test_gift_lines(spark):
    web = spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, 2), (3, 3)],
                                "ws_bill_customer_sk int, ws_ship_customer_sk int")
    assert D.gift_line_items(MartFrames({"fact_web_sales": web})).first().gift_line_items == 1
