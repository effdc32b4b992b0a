"""Run log: append entries and report on them (K06-K08, D31/D32 use it too).

Log schema: id bigint, backup_type string, started_at timestamp,
status string, size_bytes bigint, duration_secs int, notes string.
``as_of`` stands for the database's ``now()`` so reports are testable.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.functions.fmt import size_pretty

RUN_LOG_SCHEMA = ("id bigint, backup_type string, started_at timestamp, status string, "
                  "size_bytes bigint, duration_secs int, notes string")
US_PER_HOUR = 3_600_000_000
US_PER_DAY = 86_400_000_000


def log_run(spark: SparkSession, log_path: str, backup_type: str, status: str, size_bytes: int | None = None,
            duration_secs: int | None = None, notes: str | None = None,
            started_at: _dt.datetime | None = None) -> None:
    """Append one entry (append-only, like the identity-keyed source table)."""
    started = started_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rid = int(started.replace(tzinfo=_dt.timezone.utc).timestamp() * 1_000_000)
    row = [(rid, backup_type, started, status, size_bytes, duration_secs, notes)]
    spark.createDataFrame(row, RUN_LOG_SCHEMA).write.mode("append").parquet(log_path)


def _age_us(as_of: _dt.datetime, ts: Column) -> Column:
    return F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))


def _tenths(age_us: Column, unit_us: int) -> Column:
    """Age in tenths of the unit, rounded half away from zero, exactly in integers."""
    a = F.abs(age_us).cast("decimal(20,0)")
    # exact decimal quotient (scale 12 resolves every remainder of 2*unit_us), then floor
    q = F.floor((a * 20 + F.lit(Decimal(unit_us))) / F.lit(Decimal(2 * unit_us))).cast("bigint")
    return F.when(age_us < 0, -q).otherwise(q)


# The alert texts of the scheduled checks.  The source's
# RAISE placeholders are written ``%.1f``; the number is rendered here with
# one decimal, as the placeholder intends.
MSG_MISSING = "DR_ALERT: No successful {label} backup found in backup_log. Check host crontab."
MSG_STALE = "DR_ALERT: Last {label} was {age} {unit} ago (threshold: {threshold}{suffix}). Check host crontab."
MSG_OK = "DR_CHECK: Last {label} was {age} {unit} ago. OK."
MSG_STATS = "DR_STATS: type={type} count={count} total_size={size} latest={latest}"


def _fmt(template: str, **parts) -> Column:
    """Fill a message template whose parts are literals or columns."""
    pieces, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        pieces += [F.lit(head), parts[key] if isinstance(parts[key], Column) else F.lit(str(parts[key]))]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def freshness_check(run_log: DataFrame, label: str, as_of: _dt.datetime, threshold: float, unit: str = "hours",
                    type_prefix: str | None = None, type_equals: str | None = None) -> DataFrame:
    """Latest successful run of a type vs a threshold -> missing / stale / ok.

    ``type_prefix`` is a ``LIKE 'prefix%'`` pattern; ``type_equals`` matches
    exactly.  One output row: state, level (WARNING/NOTICE) and the alert text.
    """
    unit_us = US_PER_HOUR if unit == "hours" else US_PER_DAY
    log = run_log.filter(F.col("status") == "success")
    if type_prefix is not None:  # LIKE 'prefix%' as in the source ('_' matches any one character)
        log = log.filter(F.col("backup_type").like(type_prefix + "%"))
    if type_equals is not None:
        log = log.filter(F.col("backup_type") == type_equals)
    g = log.agg(F.max("started_at").alias("last_success"))
    age_us = _age_us(as_of, F.col("last_success"))
    tenths = _tenths(age_us, unit_us)
    age_text = F.concat(F.when(tenths < 0, "-").otherwise(""), (F.abs(tenths) / 10).cast("bigint").cast("string"),
                        F.lit("."), (F.abs(tenths) % 10).cast("string"))
    stale = age_us > F.lit(int(threshold * unit_us))
    missing = F.col("last_success").isNull()
    state = F.when(missing, "missing").when(stale, "stale").otherwise("ok")
    common = dict(label=label, age=age_text, unit=unit, threshold=f"{threshold:g}", suffix=unit[0])
    msg = (F.when(missing, F.lit(MSG_MISSING.format(label=label)))
           .when(stale, _fmt(MSG_STALE, **common)).otherwise(_fmt(MSG_OK, **common)))
    return g.select(F.lit(label).alias("check_name"), "last_success",
                    (age_us.cast("double") / F.lit(float(unit_us))).alias("age"),
                    F.lit(unit).alias("unit"), state.alias("state"),
                    F.when(state == "ok", "NOTICE").otherwise("WARNING").alias("level"), msg.alias("message"))


def storage_report(run_log: DataFrame, as_of: _dt.datetime, days: int = 30) -> DataFrame:
    """Per type over the last ``days``: successful runs, total size (readable), latest."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days))
    log = run_log.filter((F.col("status") == "success") & (F.col("started_at") > since))
    g = log.groupBy("backup_type").agg(F.count(F.lit(1)).alias("total_backups"),
                                        F.sum("size_bytes").alias("bytes"), F.max("started_at").alias("latest"))
    size = size_pretty("bytes")
    msg = _fmt(MSG_STATS, type=F.col("backup_type"), count=F.col("total_backups").cast("string"), size=size,
               latest=timestamptz_text("latest"))
    return g.select("backup_type", "total_backups", size.alias("total_size"), "latest",
                    msg.alias("message")).orderBy("backup_type")


def timestamptz_text(c: Column | str) -> Column:
    """A UTC timestamp as the source database prints it: seconds, then the
    fraction without trailing zeros (none if zero), then '+00'."""
    ts = (F.col(c) if isinstance(c, str) else c).cast("timestamp")
    micros = F.unix_micros(ts) % 1_000_000
    frac = F.when(micros > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(micros.cast("string"), 6, "0"), "0+$", "")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.coalesce(frac, F.lit("")), F.lit("+00"))
