"""Oracle SQL (DuckDB) for the run-log checks and dashboard expressions."""

from __future__ import annotations

from shopstar.plans.examples_sql import size_pretty_sql
from shopstar.plans.oracle import rdiv, with_marts

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
W_US = 6 * 3600 * 1_000_000


def _freshness(label: str, cond: str, unit: str, unit_us: int, threshold: int) -> str:
    age = f"(epoch_us({AS_OF}) - epoch_us(last_success))"
    t = rdiv(age, str(unit_us // 10))
    text = (f"CASE WHEN {t} < 0 THEN '-' ELSE '' END || CAST(abs({t}) // 10 AS VARCHAR) || '.' || "
            f"CAST(abs({t}) % 10 AS VARCHAR)")
    stale = f"{age} > {threshold * unit_us}"
    return f"""
SELECT '{label}' AS check_name, last_success, CAST({age} AS DOUBLE) / CAST({unit_us} AS DOUBLE) AS age,
       '{unit}' AS unit,
       CASE WHEN last_success IS NULL THEN 'missing' WHEN {stale} THEN 'stale' ELSE 'ok' END AS state,
       CASE WHEN last_success IS NOT NULL AND NOT ({stale}) THEN 'NOTICE' ELSE 'WARNING' END AS level,
       CASE WHEN last_success IS NULL
            THEN 'DR_ALERT: No successful {label} backup found in backup_log. Check host crontab.'
            WHEN {stale}
            THEN 'DR_ALERT: Last {label} was ' || {text} || ' {unit} ago (threshold: {threshold}{unit[0]}). Check host crontab.'
            ELSE 'DR_CHECK: Last {label} was ' || {text} || ' {unit} ago. OK.' END AS message
FROM (SELECT max(started_at) AS last_success FROM run_log WHERE status = 'success' AND {cond}) t"""


def _deltas(where: str = "") -> str:
    w = "PARTITION BY instance, datname, metric ORDER BY t, value"
    return f"""
SELECT instance, datname, metric, ts, t, value,
       CASE WHEN lag(value) OVER ({w}) IS NULL THEN 0
            WHEN value >= lag(value) OVER ({w}) THEN value - lag(value) OVER ({w})
            ELSE value END AS delta,
       lag(t) OVER ({w}) AS prev_t
FROM (SELECT instance, datname, metric, ts, epoch_us(ts) AS t, value FROM metrics {where}) m"""


def _rate(where: str = "") -> str:
    f = f"PARTITION BY instance, datname, metric ORDER BY t RANGE BETWEEN {W_US - 1} PRECEDING AND CURRENT ROW"
    up_to = "PARTITION BY instance, datname, metric ORDER BY t, value ROWS UNBOUNDED PRECEDING"
    return f"""
SELECT instance, datname, metric, ts,
       CASE WHEN t > min(t) OVER ({f})
            THEN CAST(max(c) OVER ({f}) - min(c) OVER ({f}) AS DOUBLE)
                 / (CAST(t - min(t) OVER ({f}) AS DOUBLE) / CAST(1000000 AS DOUBLE)) END AS rate
FROM (SELECT *, sum(delta) OVER ({up_to}) AS c FROM ({_deltas(where)}) d) s"""


def _latest(where: str, scale: int = 1) -> str:
    return f"""
SELECT instance, datname, metric, ts, CAST(value * {scale} AS DOUBLE) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY instance, datname, metric ORDER BY ts DESC, value DESC) AS rn
  FROM metrics WHERE {where}) x WHERE rn = 1"""


SQL = {
    "k07_freshness_checks": with_marts(
        _freshness("pg_dump", "backup_type LIKE 'dump_%'", "hours", 3_600_000_000, 26)
        + "\nUNION ALL\n"
        + _freshness("pg_basebackup", "backup_type = 'dump_signup'", "days", 86_400_000_000, 8)),
    "k08_storage_report": with_marts(f"""
SELECT backup_type, total_backups, total_size, latest,
       'DR_STATS: type=' || backup_type || ' count=' || CAST(total_backups AS VARCHAR) || ' total_size=' || total_size
       || ' latest=' || strftime(latest, '%Y-%m-%d %H:%M:%S')
       || CASE WHEN epoch_us(latest) % 1000000 > 0
               THEN '.' || regexp_replace(lpad(CAST(epoch_us(latest) % 1000000 AS VARCHAR), 6, '0'), '0+$', '')
               ELSE '' END || '+00' AS message
FROM (SELECT backup_type, count(*) AS total_backups, {size_pretty_sql('sum(size_bytes)')} AS total_size,
             max(started_at) AS latest
      FROM run_log WHERE status = 'success' AND started_at > {AS_OF} - INTERVAL 30 DAY
      GROUP BY backup_type) t
ORDER BY backup_type"""),
    "r01_latest_samples": with_marts(_latest("regexp_full_match(datname, 'db[0-2]')")),
    "r02_nonzero_latest": with_marts(f"SELECT * FROM ({_latest(chr(39).join(['metric = ', 'pg_error', '']))}) l "
                                     "WHERE value <> 0"),
    "r03_scaled_latest": with_marts(f"""
SELECT instance, datname, metric, ts, value
FROM ({_latest("metric = 'pg_view' AND instance = 'node-1'", 1000)}) l"""),
    "r04_counter_rate": with_marts(_rate()),
    "r05_counter_irate": with_marts(f"""
SELECT instance, datname, metric, ts,
       CASE WHEN t > prev_t AND t - prev_t < {W_US}
            THEN CAST(delta AS DOUBLE) / (CAST(t - prev_t AS DOUBLE) / CAST(1000000 AS DOUBLE)) END AS irate
FROM ({_deltas()}) d"""),
    "r06_avg_rate": with_marts(f"""
SELECT make_timestamp(step * 3600000000) AS step_ts, round(avg(v), 6) AS avg_rate, count(*) AS series
FROM (SELECT instance, datname, metric,
             CAST(floor(epoch_us(ts) / CAST(3600000000 AS DOUBLE)) AS BIGINT) AS step, arg_max(rate, ts) AS v
      FROM ({_rate("WHERE metric = 'pg_purchase'")}) r
      WHERE rate IS NOT NULL GROUP BY 1, 2, 3, 4) s
GROUP BY step"""),
    "r07_hit_ratio": with_marts("""
SELECT instance, datname, make_timestamp(step * 86400000000) AS step_ts,
       CASE WHEN a + b <> 0 THEN a / (a + b) END AS ratio
FROM (SELECT instance, datname, CAST(floor(epoch_us(ts) / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS step,
             CAST(arg_max(value, ts) FILTER (WHERE metric = 'pg_view') AS DOUBLE) AS a,
             CAST(arg_max(value, ts) FILTER (WHERE metric = 'pg_click') AS DOUBLE) AS b
      FROM metrics WHERE metric IN ('pg_view', 'pg_click') GROUP BY 1, 2, 3) x
WHERE a IS NOT NULL AND b IS NOT NULL"""),
    "r08_datname_values": with_marts("SELECT DISTINCT datname FROM metrics ORDER BY datname"),
    "r08_instance_values": with_marts("""
SELECT DISTINCT instance FROM metrics WHERE regexp_full_match(metric, 'pg_(view|click)') ORDER BY instance"""),
    "r08_reporting_series": with_marts("""
SELECT instance, datname, metric, ts FROM (
  SELECT instance, datname, metric, max(ts) AS ts FROM metrics
  WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1, 2, 3) l
WHERE ts > TIMESTAMP '2024-01-30 06:00:00'"""),
}
