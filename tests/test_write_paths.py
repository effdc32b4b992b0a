"""Full loads drop what the source no longer has; range reloads and restores keep the other months."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shopstar import session
from shopstar.operators import layout as L
from shopstar.operators import marts as M
from shopstar.operators import snapshot as S
from shopstar.operators import timeseries as R
from shopstar.operators import warehouse as W
from shopstar.sources import delimited as D
from shopstar.sources import paths

JAN, FEB, MAR = 2451911, 2451942, 2451970  # first days of 2001-01, -02 and -03


def fact(spark, *days):
    return spark.createDataFrame([(d, i, i) for i, d in enumerate(days)], "ss_sold_date_sk int, ss_item_sk bigint, ss_ticket_number bigint")


def months(spark, path):
    return sorted(r[0] for r in spark.read.parquet(path).select("sold_ym").distinct().collect())


def test_full_load_drops_months_that_disappeared(spark, scratch_dir):
    path = f"{scratch_dir}/f"
    L.write_fact(fact(spark, JAN, FEB, MAR), path, "ss_sold_date_sk")
    L.write_fact(fact(spark, FEB), path, "ss_sold_date_sk")
    assert months(spark, path) == [200102]


def test_range_load_replaces_its_months_only(spark, scratch_dir):
    path = f"{scratch_dir}/f"
    L.write_fact(fact(spark, JAN, FEB, FEB, MAR), path, "ss_sold_date_sk")
    L.write_fact(fact(spark, FEB), path, "ss_sold_date_sk", months=(200102, 200103))  # March became empty
    assert months(spark, path) == [200101, 200102]
    assert spark.read.parquet(path).where("sold_ym = 200102").count() == 1


def test_restore_keeps_the_layout_and_reloads_keep_the_other_months(spark, scratch_dir):
    path, target = f"{scratch_dir}/fact_store_sales", f"{scratch_dir}/back"
    L.write_fact(fact(spark, JAN, FEB, MAR), path, "ss_sold_date_sk")
    snap = S.snapshot(spark, {"fact_store_sales": L.read_fact(spark, path)}, f"{scratch_dir}/snap")
    S.restore(spark, snap, target, dry_run=False, confirm=True)
    restored = f"{target}/fact_store_sales"
    assert [n for n in paths.children(spark, restored) if "=" in n]
    L.write_fact(fact(spark, FEB, FEB), restored, "ss_sold_date_sk", months=(200102, 200102))
    assert months(spark, restored) == [200101, 200102, 200103] and spark.read.parquet(restored).count() == 4


def test_reload_facts_by_month_and_whole(spark, scratch_dir):
    cols = {t: [f for f in M.FACT_COLUMNS[t]] for t in M.FACT_COLUMNS}
    for t, names in cols.items():
        p = names[0].split("_")[0]
        key = "ss_ticket_number" if p == "ss" else f"{p}_order_number"
        rows = spark.createDataFrame([(JAN, 1, 1), (FEB, 2, 2), (MAR, 3, 3)], f"{p}_sold_date_sk int, {p}_item_sk int, {key} bigint")
        for n in names:
            if n not in rows.columns:
                rows = rows.withColumn(n, F.lit(1).cast("int" if n.endswith(("_sk", "_quantity")) else "decimal(7,2)"))
        rows.withColumn("not_declared", F.lit(1)).write.parquet(f"{scratch_dir}/staging/{t}")
    assert set(W.reload_facts(spark, scratch_dir).values()) == {3}
    store = f"{scratch_dir}/marts/fact_store_sales"
    assert spark.read.parquet(store).columns == [*M.FACT_COLUMNS["store_sales"], "sold_ym"]
    spark.read.parquet(f"{scratch_dir}/staging/store_sales").where(f"ss_sold_date_sk <> {MAR}").write.parquet(f"{scratch_dir}/next")
    spark.read.parquet(f"{scratch_dir}/next").write.mode("overwrite").parquet(f"{scratch_dir}/staging/store_sales")
    assert W.reload_facts(spark, scratch_dir, (200103, 200103))["fact_store_sales"] == 0
    assert months(spark, store) == [200101, 200102]


def test_landing_again_drops_old_rejects(spark, scratch_dir):
    src, out = f"{scratch_dir}/src", f"{scratch_dir}/raw"
    os.makedirs(src)

    def put(text):
        with open(f"{src}/income_band.dat", "w") as fh:
            fh.write(text)
    put("1|0|10\nx|1|2\n")
    D.land_raw(spark, src, "income_band", out, "overwrite")
    put("2|0|10\n")
    D.land_raw(spark, src, "income_band", out, "overwrite")
    assert spark.read.parquet(f"{out}/income_band").count() == 1
    put("x|0|10\n")
    D.land_raw(spark, src, "income_band", out, "overwrite")
    assert D.read_landed(spark, out, "income_band").count() == 0
    assert D.load_report(spark, out, ["income_band", "reason"]).count() == 0


def test_checksum_sees_where_a_null_stands(spark):
    a = spark.createDataFrame([(None, "a")], "x string, y string")
    b = spark.createDataFrame([("a", None)], "x string, y string")
    assert S.table_fingerprint(a).first().checksum != S.table_fingerprint(b).first().checksum


def samples(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t0 + dt.timedelta(seconds=s), "i", "d", "m", v) for s, v in rows],
                                 "ts timestamp_ntz, instance string, datname string, metric string, value long")


def test_rates_with_equal_timestamps(spark):
    df = samples(spark, [(0, 5), (0, 5), (0, 9), (10, 9), (10, 20), (20, 3)])
    got = sorted(((r.ts.second, r.rate) for r in R.rate(df, 60).collect()), key=str)
    # 4 at second 0 (5 to 9), 11 at second 10, a restart with 3 at second 20
    assert got == [(0, None)] * 3 + [(10, 15 / 10)] * 2 + [(20, 18 / 20)]
    inst = sorted(((r.ts.second, r.irate) for r in R.irate(df, 60).collect()), key=str)
    assert inst == [(0, None)] * 3 + [(10, 0.0), (10, None), (20, 3 / 10)]


@pytest.mark.parametrize("bucket", [1, 7, 500])
def test_rate_of_gaps_and_bucket_sizes(spark, bucket):
    rows = [(s, (s * 7) % 50) for s in (0, 1, 2, 30, 31, 200, 201, 202, 263, 900)]
    got = {int((r.ts - dt.datetime(2024, 1, 1)).total_seconds()): r.rate for r in R.rate(samples(spark, rows), 60, bucket_seconds=bucket).collect()}
    for s, _ in rows:
        seen = [(t, v) for t, v in rows if s - 60 < t <= s]
        inc = sum(b - a if b >= a else b for (_, a), (_, b) in zip(seen, seen[1:]))
        want = inc / (seen[-1][0] - seen[0][0]) if len(seen) > 1 else None
        assert got[s] == (pytest.approx(want) if want is not None else None)


def test_dense_series_is_split_over_buckets(spark):
    """One series with a second's samples every millisecond: no window group holds more than a bucket."""
    df = spark.range(60_000).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") / 1000)).cast("timestamp_ntz").alias("ts"),
                                    F.lit("i").alias("instance"), F.lit("d").alias("datname"), F.lit("m").alias("metric"), F.col("id").alias("value"))
    points = R._points(df, 1_000_000)
    assert points.groupBy(*R.SERIES, "bucket").count().agg(F.max("count")).first()[0] <= 1000
    got = R.rate(df, 30, bucket_seconds=1)
    assert got.count() == 60_000 and got.where("rate is not null and abs(rate - 1000) > 1e-6").count() == 0


def test_result_settings_must_take(spark, monkeypatch):
    monkeypatch.setitem(session.SESSION_CONF, "spark.sql.session.timeZone", "utc ")
    with pytest.raises(Exception):  # noqa: B017
        session.apply_session_conf(spark)
    monkeypatch.undo()
    session.apply_session_conf(spark)


class _Cluster:
    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_no_machine_local_scratch_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(_Cluster)


def test_views_of_a_written_warehouse(spark, scratch_dir):
    spark.range(3).write.parquet(f"{scratch_dir}/dim_item")
    assert M.register_views(spark, M.WrittenMarts(spark, scratch_dir)) == ["dim_item"]


@pytest.mark.parametrize("name", ["q2_top_categories", "q3_store_ranking", "q4_customer_segments", "q10_top_brands"])
def test_keys_beyond_32_bits(spark, scratch_dir, name):
    """The same rows with keys moved past 2^31 give the same report."""
    from shopstar.plans import registry
    from tests.conftest import SF_SMALL
    shift, keys = 7 * 11 * 5 * 12 * 60 * 31 * 250 * 3_000, {
        "part": ["p_partkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_custkey"],
        "lineitem": ["l_partkey", "l_suppkey"], "nation": [], "region": []}
    for t, cols in keys.items():
        df = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        for c in cols:
            df = df.withColumn(c, F.col(c) + F.lit(shift))
        df.write.parquet(f"{scratch_dir}/{t}.parquet")
    plain = registry.queries()[name](spark, SF_SMALL).collect()
    moved = registry.queries()[name](spark, scratch_dir).collect()
    assert shift > 2 ** 31 and len(plain) == len(moved) > 0
