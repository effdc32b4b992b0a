"""Reports give the same rows over written (partitioned, clustered) marts as over derived ones."""
import os

import pytest

import __spark_entry__ as E
from shopstar.plans import registry
from shopstar.operators.layout import partition_report
from shopstar.operators.marts import WrittenMarts, write_marts
from shopstar.plans.registry import on_marts
from shopstar.sources.testmarts import DerivedMarts
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def marts_pair(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("marts"))
    derived = DerivedMarts(spark, SF_SMALL)
    write_marts(derived, out)
    return derived, WrittenMarts(spark, out), out


def test_fact_layout(marts_pair):
    _, written, out = marts_pair
    parts = [d for d in os.listdir(f"{out}/fact_store_sales") if d.startswith("sold_ym=")]
    assert len(parts) > 12
    rep = partition_report(written.fact_store_sales, "ss_sold_date_sk").collect()
    assert sum(r.rows for r in rep) == written.fact_store_sales.count()


def test_year_filter_prunes_partitions(marts_pair):
    from shopstar.operators.layout import restrict_years
    _, written, _ = marts_pair
    plan = restrict_years(written.fact_store_sales, "ss_sold_date_sk", (1998, 1999))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sold_ym" in plan


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n.startswith(("q", "d", "n", "g"))))
def test_same_rows_on_written_marts(marts_pair, name):
    derived, written, _ = marts_pair
    a = sorted(map(repr, on_marts(name, derived).collect()))
    b = sorted(map(repr, on_marts(name, written).collect()))
    assert a == b


def test_null_dates_land_in_default_partition_and_reload_is_dynamic(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal

    from shopstar.operators.layout import write_fact
    rows = [(2451911, 1, Decimal("1.00")), (2451942, 2, Decimal("2.00")), (None, 3, Decimal("3.00"))]
    df = spark.createDataFrame(rows, "ss_sold_date_sk int, ss_item_sk int, ss_net_paid decimal(7,2)")
    path = str(tmp_path / "fact")
    write_fact(df, path, "ss_sold_date_sk", "ss_item_sk")
    parts = sorted(os.listdir(path))
    assert "sold_ym=200101" in parts and "sold_ym=200102" in parts and "sold_ym=__HIVE_DEFAULT_PARTITION__" in parts
    # reload January only: February and the unknown partition stay untouched
    write_fact(spark.createDataFrame([(2451912, 9, Decimal("9.00"))], df.schema), path, "ss_sold_date_sk", months=(200101, 200101))
    back = {r.ss_item_sk for r in spark.read.parquet(path).collect()}
    assert back == {9, 2, 3}
    rep = {r.partition: r.rows for r in partition_report(spark.read.parquet(path), "ss_sold_date_sk").collect()}
    assert rep == {"200101": 1, "200102": 1, "__unknown__": 1}
    assert dt.date(2001, 1, 1)


def test_analyze_table_collects_statistics(spark, tmp_path):
    from shopstar.operators.layout import analyze_table, register_table
    path = str(tmp_path / "dim")
    spark.range(100).withColumnRenamed("id", "k").write.parquet(path)
    register_table(spark, "dim_probe", path)
    stats = analyze_table(spark, "dim_probe").collect()
    assert stats and "100 rows" in stats[0].data_type


def test_sql_on_registered_views_matches_dataframe_report(spark, marts_pair):
    from shopstar.operators.marts import register_views
    from shopstar.plans import examples as D
    _, written, _ = marts_pair
    assert "fact_store_sales" in register_views(spark, written)
    sql = spark.sql("""
        SELECT d.year, d.month, CAST(SUM(ss_net_paid) AS DOUBLE) AS revenue
        FROM fact_store_sales f JOIN dim_date d ON f.ss_sold_date_sk = d.date_sk
        GROUP BY d.year, d.month""")
    assert sorted(sql.collect()) == sorted(D.monthly_store_revenue(written).collect())


def test_hot_item_month_is_split_across_files(spark, tmp_path):
    from decimal import Decimal

    from shopstar.operators.layout import write_fact
    # one (month, item) pair holds every row: the row hash still spreads it over tasks
    rows = [(2451911, 7, i, Decimal("1.00")) for i in range(4000)]
    df = spark.createDataFrame(rows, "ss_sold_date_sk int, ss_item_sk int, ss_ticket_number bigint, ss_net_paid decimal(7,2)")
    path = str(tmp_path / "hot")
    write_fact(df, path, "ss_sold_date_sk", "ss_item_sk", partitions=4)
    files = [f for f in os.listdir(os.path.join(path, "sold_ym=200101")) if f.endswith(".parquet")]
    assert len(files) >= 3
    assert spark.read.parquet(path).count() == 4000


def test_analyze_marts_registers_and_counts(spark, marts_pair):
    from shopstar.operators.marts import analyze_marts
    derived, _, out = marts_pair
    stats = {r.table_name: r.statistics for r in analyze_marts(spark, out, "marts_probe").collect()}
    assert set(stats) == {"dim_date", "dim_customer", "dim_item", "dim_store", "dim_promotion",
                          "fact_store_sales", "fact_web_sales", "fact_catalog_sales"}
    n = derived.fact_store_sales.count()
    assert f"{n} rows" in stats["fact_store_sales"]
