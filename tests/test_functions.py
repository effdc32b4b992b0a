import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shopstar.functions.dates import julian_key, key_to_date, safe_make_date
from shopstar.functions.fmt import size_pretty
from shopstar.functions.numeric import exact_avg, millions, pct


def test_julian_keys(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1),), (dt.date(2001, 1, 1),)], "d date")
    rows = df.select(julian_key("d").alias("k"), key_to_date(julian_key("d")).alias("back")).collect()
    assert [r.k for r in rows] == [2451545, 2451911]
    assert [r.back for r in rows] == [dt.date(2000, 1, 1), dt.date(2001, 1, 1)]


def test_safe_make_date_impossible_is_null(spark):
    df = spark.createDataFrame([(1970, 2, 30), (1970, 2, 28)], "y int, m int, d int")
    assert [r[0] for r in df.select(safe_make_date("y", "m", "d")).collect()] == [None, dt.date(1970, 2, 28)]


def test_exact_average_rounds_once(spark):
    # avg(decimal) keeps 6 places and rounds twice (1.0049999 -> 1.005000 -> 1.01); sum/count does not
    df = spark.createDataFrame([(Decimal("1.0049999"),)], "x decimal(12,7)")
    r = df.agg(exact_avg(F.sum("x"), F.count("x")).alias("a")).first()
    assert r.a == Decimal("1.00")


def test_half_away_from_zero_and_units(spark):
    df = spark.createDataFrame([(Decimal("2345000.00"), Decimal("-2345000.00"))], "a decimal(12,2), b decimal(12,2)")
    r = df.select(millions("a").alias("a"), millions("b").alias("b"), pct("a", "a").alias("p")).first()
    assert (r.a, r.b, r.p) == (Decimal("2.35"), Decimal("-2.35"), Decimal("100.00"))


def test_pct_divide_by_zero_is_null(spark):
    df = spark.createDataFrame([(Decimal("1.00"), Decimal("0.00"))], "a decimal(12,2), b decimal(12,2)")
    assert df.select(pct("a", "b")).first()[0] is None


def test_size_pretty(spark):
    cases = {0: "0 bytes", 10239: "10239 bytes", 10240: "10 kB", 10752: "11 kB", 1048576: "1024 kB",
             10485247: "10239 kB", 10485760: "10 MB", 5 * 1024 ** 3: "5120 MB", 20 * 1024 ** 3: "20 GB",
             3 * 1024 ** 5 * 10: "30 PB", -20000: "-20 kB"}
    df = spark.createDataFrame([(k,) for k in cases], "b bigint")
    got = {r.b: r.s for r in df.select("b", size_pretty("b").alias("s")).collect()}
    assert got == cases


def test_cluster_conf_scales_with_input():
    from shopstar.session import cluster_conf
    big = cluster_conf(100 * 1024 ** 4, 8000)       # 100 TB on 8000 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    small = cluster_conf(10 * 1024 ** 2, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
