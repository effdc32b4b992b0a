"""Registered reports over the operational tables derived from ``events``:
run-log checks (K07, K08) and dashboard expressions (R01-R08)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from shopstar.operators import runlog as K
from shopstar.operators import timeseries as R

AS_OF = _dt.datetime(2024, 2, 1)
# Test events arrive every few hours per series (the dashboard scrapes every
# 15 s); windows and steps are scaled to that density.
RATE_WINDOW_S = 6 * 3600
AVG_STEP_S = 3600
RATIO_STEP_S = 86400


def freshness_checks(m):
    """Prefix check in hours (26 h) and exact-type check in days (8 d)."""
    a = K.freshness_check(m.run_log, "pg_dump", AS_OF, 26, "hours", type_prefix="dump_")
    b = K.freshness_check(m.run_log, "pg_basebackup", AS_OF, 8, "days", type_equals="dump_signup")
    return a.unionByName(b)


def storage_report(m):
    """30-day storage report per run type."""
    return K.storage_report(m.run_log, AS_OF, 30)


def _as_float(df):
    """Metric values leave the dashboard expressions as floats."""
    return df.withColumn("value", F.col("value").cast("double"))


def latest_samples(m):
    """Latest sample per series with a regex label matcher."""
    return _as_float(R.latest_samples(m.metrics, matchers={"datname": ("=~", "db[0-2]")}))


def nonzero_latest(m):
    """Latest samples that are not zero."""
    return _as_float(R.nonzero_values(R.latest_samples(m.metrics, metric="pg_error")))


def scaled_latest(m):
    """Latest view counter times 1000."""
    latest = R.latest_samples(m.metrics, metric="pg_view", matchers={"instance": ("=", "node-1")})
    return R.scale_values(latest, 1000).withColumn("value", F.col("value").cast("double"))


def counter_rate(m):
    """Per-second counter rate over a trailing window at every sample."""
    return R.rate(m.metrics, RATE_WINDOW_S)


def counter_irate(m):
    """Instant rate from the last two samples in the window."""
    return R.irate(m.metrics, RATE_WINDOW_S)


def avg_rate(m):
    """Average purchase-counter rate across series per step."""
    return R.avg_by_step(R.rate(m.metrics, RATE_WINDOW_S, metric="pg_purchase"), "rate", AVG_STEP_S)


def hit_ratio(m):
    """View / (view + click) on matching labels per day."""
    return R.metric_ratio(m.metrics, "pg_view", "pg_click", RATIO_STEP_S)


def datname_values(m):
    """Values of the database label."""
    return R.label_values(m.metrics, "datname")


def instance_values(m):
    """Instances reporting view or click metrics."""
    return R.label_values(m.metrics, "instance", "pg_(view|click)")


def reporting(m):
    """Series reporting within the last 6 h before ``AS_OF``."""
    return R.reporting_series(m.metrics, _dt.datetime(2024, 1, 30, 12), 6 * 3600)


def registry(on):
    return {
        "k07_freshness_checks": on(freshness_checks),
        "k08_storage_report": on(storage_report),
        "r01_latest_samples": on(latest_samples),
        "r02_nonzero_latest": on(nonzero_latest),
        "r03_scaled_latest": on(scaled_latest),
        "r04_counter_rate": on(counter_rate),
        "r05_counter_irate": on(counter_irate),
        "r06_avg_rate": on(avg_rate),
        "r07_hit_ratio": on(hit_ratio),
        "r08_datname_values": on(datname_values),
        "r08_instance_values": on(instance_values),
        "r08_reporting_series": on(reporting),
    }
