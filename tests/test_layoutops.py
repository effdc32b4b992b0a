"""Pruned months, containment joins, bucketed links, step grids, versioned loads and repaired parts on hand-made data."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from shopstar.operators import layout as L
from shopstar.operators import marts as M
from shopstar.operators import snapshot as S
from shopstar.operators import timeseries as R
from shopstar.operators.intervals import containment_join
from shopstar.operators.versions import VersionedFact, reload_months
from shopstar.plans import layoutops as Y

DAY0 = 2451545  # 2000-01-01


def plan(df):
    return df._jdf.queryExecution().toString()


def calendar(spark, days=800):
    d = F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int"))
    return spark.range(days).select((F.col("id") + DAY0).cast("int").alias("date_sk"), F.year(d).alias("year"), F.quarter(d).alias("quarter"))


def fact(spark, p, n=800):
    return spark.range(n).select((F.col("id") + DAY0).cast("int").alias(f"{p}_sold_date_sk"), F.col("id").alias(f"{p}_item_sk"),
                                 F.col("id").alias(f"{p}_number"), F.lit("1.50").cast("decimal(12,2)").alias(f"{p}_net_paid"))


# ------------------------------------------------------------ S15
def test_calendar_filter_prunes_months(spark, scratch_dir):
    facts = {}
    for t, key in L.FACT_DATE_KEY.items():
        L.write_fact(fact(spark, key[:2]), f"{scratch_dir}/{t}", key)
        facts[t] = L.read_fact(spark, f"{scratch_dir}/{t}")
    calendar(spark).write.parquet(f"{scratch_dir}/dim_date")
    days = M.WrittenMarts(spark, scratch_dir).dim_date
    assert L.PARTITION_COL in days.columns
    # files of other quarters become unreadable: only a scan that skips their months can answer
    for path in glob.glob(f"{scratch_dir}/fact_*/sold_ym=*/*.parquet"):
        if int(path.split("sold_ym=")[1][4:6]) < 10:
            with open(path, "wb") as f:
                f.write(b"no parquet")
            crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    got = Y.quarter_of_written_facts(facts, days)
    assert "dynamicpruning" in plan(got)
    assert {(r.fact, r.year, r.line_items, r.revenue) for r in got.collect()} == {(t, y, 92, 138.0) for t in facts for y in (2000, 2001)}


# ------------------------------------------------------------ J10
@pytest.mark.parametrize("by", [[], ["k"]])
def test_containment_join_matches_brute_force(spark, by):
    r = random.Random(len(by))
    points = [(r.choice([1, 2, None]), i, r.choice([None, r.randrange(-300, 300)])) for i in range(150)]
    spans = [(r.choice([1, 2, None]), i, r.choice([None, r.randrange(-400, 300)]), r.choice([None, r.randrange(-300, 500)])) for i in range(80)]
    p = spark.createDataFrame(points, "k int, p int, x int")
    s = spark.createDataFrame(spans, "k int, s int, a int, b int")
    s = s if by else s.withColumnRenamed("k", "k2")
    for width in (7, 1000):
        got = containment_join(p, s, "x", "a", "b", by, width)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
        want = sorted((i, j) for k, i, x in points for k2, j, a, b in spans
                      if x is not None and (a is None or a <= x) and (b is None or x <= b) and (not by or k is not None and k == k2))
        assert sorted((q.p, q.s) for q in got.collect()) == want
    assert containment_join(p.limit(0), s, "x", "a", "b", by).count() == 0


# ------------------------------------------------------------ J06
def test_bucketed_tables_join_without_an_exchange(spark, scratch_dir):
    keys, tag = ["channel", "number", "item"], os.path.basename(scratch_dir).replace("-", "_").lower()
    rows = [(c, i % 97, i % 13) for i in range(600) for c in ("web", "store")]
    a = L.write_bucketed(spark.createDataFrame(rows, "channel string, number long, item long"), f"a_{tag}", f"{scratch_dir}/a", keys, 4)
    b = L.write_bucketed(spark.createDataFrame(rows[::5], "channel string, number long, item long"), f"b_{tag}", f"{scratch_dir}/b", keys, 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        j = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
        physical = plan(j).split("== Physical Plan ==")[1]
        assert "SortMergeJoin" in physical and "Exchange" not in physical
        assert sum(r.n * r.m for r in j.collect()) == sum(1 for x in rows[::5] for y in rows if x == y)
        assert len(glob.glob(f"{scratch_dir}/a/*.parquet")) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE a_{tag}")
        spark.sql(f"DROP TABLE b_{tag}")


# ------------------------------------------------------------ R01, R04, R06 on steps
T0 = dt.datetime(2024, 1, 1)


def samples(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=t), s, "db", "c", v) for s, t, v in rows],
                                 "ts timestamp_ntz, instance string, datname string, metric string, value long")


@pytest.mark.parametrize("step,back,span", [(15, 60, 3000), (7, 3, 2500), (100, 1000, 60000)])
def test_steps_match_brute_force(spark, step, back, span):
    r = random.Random(step)
    rows = [(f"n{r.randrange(3)}", r.randrange(-200, span), r.randrange(1000)) for _ in range(260)]
    df, end = samples(spark, rows), T0 + dt.timedelta(seconds=span)
    latest = {(q.instance, int((q.step_ts - T0).total_seconds())): (int((q.ts - T0).total_seconds()), q.value)
              for q in R.latest_at_steps(df, T0, end, step, back).collect()}
    rates = {(q.instance, int((q.step_ts - T0).total_seconds())): q.rate for q in R.rate_at_steps(df, T0, end, step, back).collect()}
    want, want_rate = {}, {}
    for s in ("n0", "n1", "n2"):
        own = sorted((t, v) for x, t, v in rows if x == s)
        total, sums = 0, []
        for i, (t, v) in enumerate(own):
            total += 0 if not i else v - own[i - 1][1] if v >= own[i - 1][1] else v
            sums.append((t, total))
        for k in range(0, span + 1, step):
            held = [(t, v) for t, v in own if k - back < t <= k]
            if held:
                want[s, k] = max(held)
                c = [(t, v) for t, v in sums if k - back < t <= k]
                want_rate[s, k] = (max(v for _, v in c) - min(v for _, v in c)) / (c[-1][0] - c[0][0]) if c[-1][0] > c[0][0] else None
    assert latest == want
    assert rates.keys() == want_rate.keys()
    assert all(rates[k] == (pytest.approx(v) if v is not None else None) for k, v in want_rate.items())
    avg = {int((q.step_ts - T0).total_seconds()): (q.avg_rate, q.series) for q in R.avg_at_steps(R.rate_at_steps(df, T0, end, step, back), "rate").collect()}
    for k in avg:
        values = [v for (_, at), v in want_rate.items() if at == k and v is not None]
        assert avg[k] == (pytest.approx(sum(values) / len(values), abs=1e-6), len(values))


def test_rate_frames_grow_from_one_side(spark):
    df = samples(spark, [("n", t, t) for t in range(50)])
    for out in (R.rate(df, 60), R.irate(df, 60), R.rate_at_steps(df, T0, T0 + dt.timedelta(seconds=50), 5, 20)):
        frames = plan(out).split("== Physical Plan ==")[1].lower()
        assert "unboundedfollowing" not in frames.replace("unboundedpreceding$(), unboundedfollowing", "")


# ------------------------------------------------------------ S10
def test_load_that_dies_leaves_the_version_before(spark, scratch_dir, monkeypatch):
    sold = lambda *days: spark.createDataFrame([(d, i) for i, d in enumerate(days)], "ss_sold_date_sk int, ss_item_sk int")
    jan, feb, mar = DAY0, DAY0 + 31, DAY0 + 60
    f = VersionedFact(spark, f"{scratch_dir}/f", "ss_sold_date_sk")
    with pytest.raises(ValueError):
        f.read()
    assert f.publish(sold(jan, feb, feb, mar, None)) == 1
    reader = f.read()  # keeps its version whatever happens later
    broken = sold(feb, mar).withColumn("ss_item_sk", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):  # dies while it writes its files
        f.publish(broken, (200002, 200003))
    with monkeypatch.context() as m:  # dies between its files and its version
        m.setattr(f, "_switch", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            f.publish(sold(feb), (200002, 200003))
    os.makedirs(f"{scratch_dir}/f/_versions/v=2")  # dies while it writes its version
    assert f.version() == 1 and f.read().count() == 5
    assert reload_months(f, sold(jan, jan, feb, None), (200002, 200003)) == 2  # March became empty
    count = {r.sold_ym: r["count"] for r in f.read().groupBy("sold_ym").count().collect()}
    assert count == {200001: 1, 200002: 1, None: 1}
    assert reader.count() == 5 and f.read(1).count() == 5
    with pytest.raises(ValueError):
        f.publish(sold(jan), (200002, 200003))
    assert f.publish(sold(mar)) == 3 and f.read().count() == 1
    assert len(f.clean()) >= 3 and f.read().count() == 1


# ------------------------------------------------------------ K03, K05
def test_damage_is_located_and_only_its_parts_are_repaired(spark, scratch_dir):
    rows = spark.range(400).select((F.col("id") + DAY0).cast("int").alias("d"), F.col("id").alias("i"))
    f = rows.withColumn(L.PARTITION_COL, F.when(F.col("i") % 50 != 0, L.sold_ym("d")))
    dim = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    snap, live = S.snapshot(spark, {"f": f, "dim": dim, "gone": dim}, f"{scratch_dir}/snaps"), f"{scratch_dir}/live"
    S.restore(spark, snap, live, ["f", "dim"], dry_run=False, confirm=True)
    assert {(r.table_name, r.part, r.state) for r in S.damaged_parts(spark, snap, live).collect()} == {("gone", "all", "missing")}
    held = spark.read.parquet(f"{snap}/f")
    ym = F.col(L.PARTITION_COL)
    bad = held.where("sold_ym <> 200003 or sold_ym is null").withColumn("i", F.when(ym == 200005, F.col("i") + 1).otherwise(F.col("i")))
    bad = bad.where("not (sold_ym = 200007 and i % 2 = 0)").unionByName(spark.createDataFrame([(1, 1, 199901)], "d int, i long, sold_ym int"))
    L.write_table(bad.where("sold_ym is not null"), f"{live}/f")
    L.write_table(dim.where("k = 1"), f"{live}/dim")
    found = {("f", "200003", "missing"), ("f", "200005", "content"), ("f", "200007", "rows"), ("f", "199901", "unexpected"), ("f", "undated", "missing"),
             ("dim", "all", "rows")}
    untouched = {p for p in glob.glob(f"{live}/f/sold_ym=*/*.parquet") if p.split("sold_ym=")[1][:6] not in ("200005", "200007", "199901")}
    assert set(S.repair(spark, snap, live, ["f", "dim"])) == found
    assert S.damaged_parts(spark, snap, live, ["f", "dim"]).count() == 0
    assert untouched <= set(glob.glob(f"{live}/f/sold_ym=*/*.parquet"))
