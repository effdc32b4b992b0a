"""Property: the closed form of the literal Q1/Q7 equals the multiplying three-fact join
on random facts with NULL dates and NULL amounts."""
import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopstar.operators.marts import MartFrames
from shopstar.plans import analytics as A

DAYS = [dt.date(1999, 12, 30), dt.date(1999, 12, 31), dt.date(2000, 1, 1), dt.date(2000, 6, 1), dt.date(2001, 2, 3)]


def jk(d):
    return (d - dt.date(2000, 1, 1)).days + 2451545


row = st.tuples(st.one_of(st.none(), st.sampled_from([jk(d) for d in DAYS])),
                st.one_of(st.none(), st.integers(-500, 5000).map(lambda c: Decimal(c) / 100)))
facts = st.lists(row, max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(s=facts, w=facts, c=facts)
def test_closed_form_equals_direct_join(spark, s, w, c):
    dd = spark.createDataFrame([(jk(d), d.year) for d in DAYS], "date_sk int, year int")

    def fact(rows, p):
        return spark.createDataFrame([(k, 1, v) for k, v in rows],
                                     f"{p}_sold_date_sk int, {p}_item_sk int, {p}_net_paid decimal(7,2)")
    m = MartFrames({"dim_date": dd, "fact_store_sales": fact(s, "ss"), "fact_web_sales": fact(w, "ws"),
                    "fact_catalog_sales": fact(c, "cs")})
    j = (dd.join(m.fact_store_sales, F.col("date_sk") == F.col("ss_sold_date_sk"), "left")
         .join(m.fact_web_sales, F.col("date_sk") == F.col("ws_sold_date_sk"), "left")
         .join(m.fact_catalog_sales, F.col("date_sk") == F.col("cs_sold_date_sk"), "left"))
    direct = {r.year: (r.s, r.w, r.c) for r in j.groupBy("year").agg(
        F.sum("ss_net_paid").alias("s"), F.sum("ws_net_paid").alias("w"), F.sum("cs_net_paid").alias("c")).collect()}
    closed = {r.year: (r.store_paid, r.web_paid, r.catalog_paid)
              for r in A._yearly_channel_sums(m, (1998, 2002), literal=True).collect()}
    assert set(direct) == set(closed)
    for y in direct:
        assert tuple(None if v is None else Decimal(v) for v in direct[y]) == \
            tuple(None if v is None else Decimal(v) for v in closed[y])


samples = st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 50)), min_size=1, max_size=25,
                   unique_by=lambda x: x[0])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=samples, window=st.sampled_from([30, 60, 300]), bucket=st.sampled_from([None, 45, 120, 700]))
def test_bucketed_rate_equals_brute_force(spark, rows, window, bucket):
    from shopstar.operators.timeseries import irate, rate
    rows = sorted(rows)
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(seconds=s), "i", "d", "m", Decimal(v)) for s, v in rows],
                               "ts timestamp, instance string, datname string, metric string, value decimal(12,2)")
    got = {int((r.ts - t0).total_seconds()): r.rate for r in rate(df, window, bucket_seconds=bucket).collect()}
    got_i = {int((r.ts - t0).total_seconds()): r.irate for r in irate(df, window, bucket_seconds=bucket).collect()}
    for i, (t, v) in enumerate(rows):
        win = [(s, x) for s, x in rows if t - window < s <= t]
        if len(win) < 2:
            assert got[t] is None
        else:
            inc = sum((x1 - x0) if x1 >= x0 else x1 for (_, x0), (_, x1) in zip(win, win[1:]))
            assert abs(got[t] - inc / (win[-1][0] - win[0][0])) < 1e-9
        if i == 0 or t - rows[i - 1][0] >= window:
            assert got_i[t] is None
        else:
            p = rows[i - 1][1]
            assert abs(got_i[t] - ((v - p) if v >= p else v) / (t - rows[i - 1][0])) < 1e-9


pairs = st.lists(st.tuples(st.integers(1, 4), st.integers(1, 3)), max_size=15)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sales=pairs, returns=pairs)
def test_return_rate_counts_equal_the_left_join(spark, sales, returns):
    """D27's reduced form equals the source's LEFT JOIN counting, duplicates included."""
    from shopstar.plans.examples import return_rate_by_category
    ss = spark.createDataFrame([(t, i) for t, i in sales] or [(None, None)],
                               "ss_ticket_number bigint, ss_item_sk int").filter("ss_item_sk is not null")
    sr = spark.createDataFrame([(t, i) for t, i in returns] or [(None, None)],
                               "sr_ticket_number bigint, sr_item_sk int").filter("sr_item_sk is not null")
    item = spark.createDataFrame([(1, "p1", "A"), (2, "p2", "A"), (3, "p3", "B")],
                                 "item_sk int, product_name string, category string")
    m = MartFrames({"store_sales": ss, "store_returns": sr, "dim_item": item})
    got = {r.i_category: (r.returns, r.sales) for r in return_rate_by_category(m).collect()}
    j = (ss.join(item, ss.ss_item_sk == item.item_sk)
         .join(sr, (sr.sr_ticket_number == ss.ss_ticket_number) & (sr.sr_item_sk == ss.ss_item_sk), "left"))
    exp = {r.category: (r.r, r.s) for r in j.groupBy("category").agg(
        F.count("sr_item_sk").alias("r"), F.count("ss_item_sk").alias("s")).collect()}
    assert got == exp


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(profits=st.lists(st.tuples(st.integers(1, 9), st.one_of(st.none(), st.integers(-3, 3))), min_size=1, max_size=20),
       top=st.integers(1, 6))
def test_topk_rank_equals_global_rank(spark, profits, top):
    """Q3's rank computed on the take-ordered top-k equals the global RANK of those rows."""
    from pyspark.sql import Window
    f = spark.createDataFrame([(s, Decimal(p) if p is not None else None) for s, p in profits],
                              "ss_store_sk int, ss_net_profit decimal(7,2)") \
        .withColumn("ss_net_paid", F.lit(Decimal("1.00")).cast("decimal(7,2)"))
    stores = spark.createDataFrame([(i, f"s{i}", "c", "st") for i in range(1, 10)],
                                   "store_sk int, store_name string, city string, state string")
    got = [(r.store_sk, r.profit_rank) for r in A.store_ranking(MartFrames({"fact_store_sales": f, "dim_store": stores}),
                                                                 top=top).collect()]
    per = f.groupBy("ss_store_sk").agg(F.sum("ss_net_profit").alias("p"))
    ranked = per.select("ss_store_sk", F.rank().over(Window.orderBy(F.col("p").desc_nulls_first())).alias("r"))
    ranks = {r.ss_store_sk: r.r for r in ranked.collect()}
    assert len(got) == min(top, len(ranks))
    assert all(ranks[s] == r for s, r in got)
    assert sorted(r for _, r in got) == sorted(ranks.values())[:len(got)]
