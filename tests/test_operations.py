"""Snapshots (K01-K05, K09), run log (K06-K08) and metric expressions (R01-R08) on hand-made data."""
import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopstar.operators import runlog as K
from shopstar.operators import snapshot as S
from shopstar.operators import timeseries as R

T0 = dt.datetime(2024, 1, 1)


# ---------------------------------------------------------------- snapshots
def test_snapshot_verify_restore_roundtrip(spark, scratch_dir):
    a = spark.createDataFrame([(i, f"n{i}", Decimal(i) / 4) for i in range(50)], "k int, name string, v decimal(7,2)")
    b = spark.createDataFrame([(1, None)], "x int, y string")
    root = os.path.join(scratch_dir, "snaps")
    path = S.snapshot(spark, {"a": a, "b": b}, root, mode="marts", snapshot_id="s1")
    man = {r.table_name: r for r in S.read_manifest(spark, path).collect()}
    assert man["a"].rows == 50 and man["b"].rows == 1 and man["a"].files >= 1 and man["a"].bytes > 0
    fp_src = S.table_fingerprint(a.repartition(3)).first()          # order-free checksum
    assert fp_src.checksum == man["a"].checksum
    rep = S.verify_snapshot(spark, path)
    assert S.verification_passed(rep)
    S.snapshot(spark, {"a": a}, root, mode="table", snapshot_id="s2")
    listed = S.list_snapshots(spark, root).collect()
    assert {r.snapshot_id for r in listed} == {"s1", "s2"}
    target = os.path.join(scratch_dir, "live")
    plan = S.restore(spark, path, target, tables=["a"]).collect()       # dry run: nothing written
    assert plan[0].action == "would overwrite" and not os.path.exists(os.path.join(target, "a"))
    done = S.restore(spark, path, target, tables=["a"], dry_run=False, confirm=True).collect()
    assert done[0].action == "restored"
    back = spark.read.parquet(os.path.join(target, "a"))
    assert S.table_fingerprint(back).first().checksum == man["a"].checksum


def test_verify_detects_tampering(spark, scratch_dir):
    a = spark.createDataFrame([(i,) for i in range(10)], "k int")
    path = S.snapshot(spark, {"a": a}, os.path.join(scratch_dir, "snaps"), snapshot_id="s1")
    spark.createDataFrame([(99,)], "k int").write.mode("append").parquet(os.path.join(path, "a"))
    rep = {r.check: r.result for r in S.verify_snapshot(spark, path).collect()}
    assert rep["row_count"] == "FAIL" and rep["checksum"] == "FAIL" and rep["schema"] == "PASS"
    with pytest.raises(ValueError):
        S.restore(spark, path, os.path.join(scratch_dir, "live"), dry_run=False, confirm=True)


def test_reconcile_counts(spark):
    actual = spark.createDataFrame([("a", 100), ("b", 50), ("c", 1)], "table_name string, rows bigint")
    expected = spark.createDataFrame([("a", 101), ("b", 70), ("d", 5)], "table_name string, expected_rows bigint")
    got = {r.table_name: r.status for r in S.reconcile_counts(actual, expected, 5.0).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "unexpected", "d": "missing"}


# ------------------------------------------------------------------ run log
def test_run_log_freshness_and_storage(spark, scratch_dir):
    log = os.path.join(scratch_dir, "log")
    now = dt.datetime(2024, 2, 1, 12, 0)
    K.log_run(spark, log, "dump_marts", "success", 20 * 1024 ** 3, 60, started_at=now - dt.timedelta(hours=25))
    K.log_run(spark, log, "dump_full", "failed", 5, 1, started_at=now - dt.timedelta(hours=1))
    K.log_run(spark, log, "basebackup", "success", 10240, 9, started_at=now - dt.timedelta(hours=27))
    df = spark.read.parquet(log)
    a = K.freshness_check(df, "pg_dump", now, 26, "hours", type_prefix="dump_").first()
    assert a.state == "ok" and a.level == "NOTICE"
    assert a.message == "DR_CHECK: Last pg_dump was 25.0 hours ago. OK."
    b = K.freshness_check(df, "pg_basebackup", now, 26, "hours", type_equals="basebackup").first()
    assert b.state == "stale" and abs(b.age - 27.0) < 1e-9 and b.level == "WARNING"
    assert b.message == "DR_ALERT: Last pg_basebackup was 27.0 hours ago (threshold: 26h). Check host crontab."
    c = K.freshness_check(df, "pg_basebackup", now, 8, "days", type_equals="nothing").first()
    assert c.state == "missing" and c.last_success is None
    assert c.message == "DR_ALERT: No successful pg_basebackup backup found in backup_log. Check host crontab."
    rep = {r.backup_type: (r.total_backups, r.total_size) for r in K.storage_report(df, now).collect()}
    assert rep == {"dump_marts": (1, "20 GB"), "basebackup": (1, "10 kB")}


# ------------------------------------------------------------------ metrics
def _metrics(spark, rows):
    return spark.createDataFrame(
        [(T0 + dt.timedelta(seconds=s), "i1", "db", "m", Decimal(str(v))) for s, v in rows],
        "ts timestamp, instance string, datname string, metric string, value decimal(12,2)")


def _brute_rate(rows, window):
    out = {}
    for i, (t, v) in enumerate(rows):
        win = [(s, x) for s, x in rows if t - window < s <= t]
        if len(win) < 2:
            out[t] = None
            continue
        inc = 0.0
        for (s0, x0), (s1, x1) in zip(win, win[1:]):
            inc += (x1 - x0) if x1 >= x0 else x1
        out[t] = inc / (win[-1][0] - win[0][0])
    return out


@pytest.mark.parametrize("bucket", [None, 60, 100])
def test_rate_with_counter_reset_matches_brute_force(spark, bucket):
    # counter samples every 15 s with a reset at t=90 (value drops to 2)
    rows = [(0, 10), (15, 12), (30, 15), (45, 15), (60, 20), (75, 25), (90, 2), (105, 6), (120, 9),
            (135, 9), (300, 12), (330, 1)]
    got = {int((r.ts - T0).total_seconds()): r.rate
           for r in R.rate(_metrics(spark, rows), 60, bucket_seconds=bucket).collect()}
    exp = _brute_rate(rows, 60)
    assert set(got) == set(exp)
    for t in exp:
        assert (got[t] is None and exp[t] is None) or abs(got[t] - exp[t]) < 1e-9, t


def test_irate_and_reset(spark):
    rows = [(0, 10), (15, 12), (30, 3), (400, 5)]
    got = {int((r.ts - T0).total_seconds()): r.irate for r in R.irate(_metrics(spark, rows), 300).collect()}
    assert got[0] is None and abs(got[15] - 2 / 15) < 1e-12 and abs(got[30] - 3 / 15) < 1e-12
    assert got[400] is None    # previous sample older than the window


def test_latest_filters_and_labels(spark):
    df = spark.createDataFrame(
        [(T0, "a", "db1", "up", Decimal("1")), (T0 + dt.timedelta(seconds=5), "a", "db1", "up", Decimal("0")),
         (T0, "b", "db22", "up", Decimal("3")), (T0, "c", "x", "down", Decimal("4"))],
        "ts timestamp, instance string, datname string, metric string, value decimal(12,2)")
    last = R.latest_samples(df, "up", {"datname": ("=~", "db[0-9]")}).collect()
    assert [(r.instance, float(r.value)) for r in last] == [("a", 0.0)]      # anchored regex: db22 excluded
    assert R.nonzero_values(R.latest_samples(df, "up")).count() == 1
    assert [r.datname for r in R.label_values(df, "datname", "u.").collect()] == ["db1", "db22"]
    rep = R.reporting_series(df, T0 + dt.timedelta(seconds=60), 30).collect()
    assert rep == []
    scaled = R.scale_values(R.latest_samples(df, "down"), 1000).first()
    assert scaled.value == Decimal("4000.00")


def test_ratio_and_avg(spark):
    df = spark.createDataFrame(
        [(T0, "a", "db", "hit", Decimal("3")), (T0, "a", "db", "read", Decimal("1")),
         (T0, "b", "db", "hit", Decimal("0")), (T0, "b", "db", "read", Decimal("0"))],
        "ts timestamp, instance string, datname string, metric string, value decimal(12,2)")
    got = {r.instance: r.ratio for r in R.metric_ratio(df, "hit", "read", 60).collect()}
    assert got == {"a": 0.75, "b": None}
    samples = spark.createDataFrame([(T0, "a", "d", "m", 1.0), (T0, "b", "d", "m", 2.0)],
                                    "ts timestamp, instance string, datname string, metric string, rate double")
    r = R.avg_by_step(samples, "rate", 15).first()
    assert r.avg_rate == 1.5 and r.series == 2


def test_schema_only_export(spark, scratch_dir):
    a = spark.createDataFrame([(1, "x")], "k int, name string")
    path = S.snapshot(spark, {"a": a}, os.path.join(scratch_dir, "snaps"), snapshot_id="ddl", schema_only=True)
    m = S.read_manifest(spark, path).first()
    assert m.mode == "schema" and m.rows is None and "name" in m.schema_json
    assert not os.path.exists(os.path.join(path, "a"))
    assert S.verification_passed(S.verify_snapshot(spark, path))
    with pytest.raises(ValueError):
        S.restore(spark, path, os.path.join(scratch_dir, "live"), dry_run=False, confirm=True)


def test_storage_message_and_timestamp_text(spark, scratch_dir):
    log = os.path.join(scratch_dir, "log2")
    now = dt.datetime(2024, 2, 1, 12, 0)
    K.log_run(spark, log, "dump_marts", "success", 2048, 1, started_at=dt.datetime(2024, 1, 31, 5, 30, 0, 120000))
    K.log_run(spark, log, "wal", "success", 20000, 1, started_at=dt.datetime(2024, 1, 31, 6, 0, 0))
    rep = {r.backup_type: r.message for r in K.storage_report(spark.read.parquet(log), now).collect()}
    assert rep["dump_marts"] == "DR_STATS: type=dump_marts count=1 total_size=2048 bytes latest=2024-01-31 05:30:00.12+00"
    assert rep["wal"] == "DR_STATS: type=wal count=1 total_size=20 kB latest=2024-01-31 06:00:00+00"


def test_label_values_with_matchers(spark):
    df = spark.createDataFrame(
        [(T0, "a", "db1", "locks", Decimal("1")), (T0, "b", "db2", "locks", Decimal("1")),
         (T0, "c", "x", "locks", Decimal("1"))],
        "ts timestamp, instance string, datname string, metric string, value decimal(12,2)")
    got = [r.instance for r in R.label_values(df, "instance", matchers={"datname": ("=~", "db.*")}).collect()]
    assert got == ["a", "b"]


def test_instant_lookup_staleness(spark):
    df = _metrics(spark, [(0, 1), (100, 2), (500, 3)])
    at = T0 + dt.timedelta(seconds=450)
    assert R.latest_samples(df, as_of=at).first().value == Decimal("2.00")
    assert R.latest_samples(df, as_of=at, lookback_seconds=300).count() == 0


def test_list_snapshots_when_none(spark, scratch_dir):
    assert S.list_snapshots(spark, os.path.join(scratch_dir, "nothing")).count() == 0
