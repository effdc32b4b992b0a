"""Oracle SQL (DuckDB): what the table operations must leave behind."""

from __future__ import annotations

from shopstar.plans.oracle import pct_c, with_marts
from shopstar.plans.tableops import CHANGED, LOST, RELOADED, SNAPSHOT_TABLES

_REJECTED = {2: "surplus columns", 3: "type or range", 4: "string too long"}
_REASON = "CASE p_partkey % 10 " + " ".join(f"WHEN {d} THEN '{r}'" for d, r in _REJECTED.items()) + " END"
_MONTH = "CAST(strftime(DATE '2000-01-01' + ({p}_sold_date_sk - 2451545), '%Y%m') AS INTEGER)"


def _partitions(rows: str, day: str) -> str:
    return f"""
SELECT ifnull(CAST(ym AS VARCHAR), '__unknown__') AS partition, count(*) AS rows, min({day}) AS min_date_sk, max({day}) AS max_date_sk,
       {pct_c('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_rows
FROM ({rows}) t GROUP BY ym"""


def _each(cells: str, tables=SNAPSHOT_TABLES) -> str:
    return " UNION ALL ".join(f"SELECT {cells.format(t=t)} FROM {t}" for t in tables)


def _each_fact(report) -> str:
    facts = (("fact_store_sales", "ss", "ss_ticket_number"), ("fact_web_sales", "ws", "ws_order_number"), ("fact_catalog_sales", "cs", "cs_order_number"))
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({report(t, p, number)})" for t, p, number in facts)


_COUNTS = _each("'{t}' AS table_name, count(*) AS n")
_CHECKS = "(VALUES ('readable'), ('non_empty'), ('schema'), ('row_count'), ('checksum')) c(check_name)"

SQL = {
    "s01_load_status": f"""
SELECT if(reason IS NULL, 'accepted', 'rejected') AS load_status, reason, count(*) AS rows FROM (SELECT {_REASON} AS reason FROM part) GROUP BY ALL""",
    "s06_raw_load_report": f"""
SELECT 'raw' AS schema, 'reason' AS "table", count(*) AS rows FROM part WHERE {_REASON} IS NULL""",
    "s11_landed_rows": f"""
SELECT CAST(p_partkey AS INTEGER) AS r_reason_sk, 'R' || p_partkey AS r_reason_id, if(p_partkey % 10 <> 1, p_name, NULL) AS r_reason_desc
FROM part WHERE {_REASON} IS NULL""",
    "s11_ledger_loads": f"""
SELECT load_id, state, count(*) AS lines, (SELECT count(*) FROM part WHERE {_REASON} IS NULL) AS rows_that_count
FROM part JOIN (VALUES ('first', 'new', 0), ('again', 'known', 0), ('second', 'new', 1), ('last', 'known', 1)) l(load_id, state, parity)
ON p_partkey % 2 = parity GROUP BY ALL""",
    "s10_reloaded_months": with_marts(_each_fact(lambda t, p, number: _partitions(
        f"SELECT *, {_MONTH.format(p=p)} AS ym FROM {t} WHERE {_MONTH.format(p=p)} <> 199503", f"{p}_sold_date_sk"))),
    "s16_undated_partition": with_marts(_each_fact(lambda t, p, number: _partitions(f"""
SELECT day, CAST(strftime(DATE '2000-01-01' + (day - 2451545), '%Y%m') AS INTEGER) AS ym
FROM (SELECT if({number} % 13 <> 0, {p}_sold_date_sk, NULL) AS day FROM {t})""", "day"))),
    "s18_table_statistics": with_marts(_each("'{t}' AS table_name, count(*) AS rows")),
    "k01_manifest": with_marts(f"SELECT table_name, 'marts' AS mode, n AS rows, true AS has_data FROM ({_COUNTS})"),
    "k02_schema_export": with_marts(_each("'{t}' AS table_name, 'schema' AS mode, CAST(max(len(json_keys(to_json({t})))) AS INTEGER) AS columns, count(*) AS rows")),
    "k03_damaged_months": with_marts(_each_fact(lambda t, p, number: f"""
SELECT CAST({_MONTH.format(p=p)} AS VARCHAR) AS part, if({_MONTH.format(p=p)} = {LOST}, 'missing', 'content') AS state, count(*) > 0 AS repaired
FROM {t} WHERE {_MONTH.format(p=p)} IN ({LOST}, {CHANGED}) GROUP BY ALL""")),
    "k03_verification": with_marts(f"""
SELECT table_name, check_name AS "check", if(check_name = 'non_empty' AND n = 0, 'FAIL', 'PASS') AS result FROM ({_COUNTS}), {_CHECKS}"""),
    "k04_snapshots": with_marts(f"""
SELECT snapshot_id, 'marts' AS mode, count(*) AS tables, CAST(sum(n) AS BIGINT) AS rows
FROM ({_COUNTS}), (VALUES ('first'), ('second')) s(snapshot_id) GROUP BY ALL"""),
    "k05_restored_rows": with_marts(f"SELECT table_name, n AS rows FROM ({_COUNTS})"),
    "k06_logged_runs": with_marts(f"""
, held AS (SELECT sum(n) > 0 AS any_rows FROM ({_COUNTS}))
SELECT 'marts_snapshot' AS backup_type, 'success' AS status, any_rows AS has_size FROM held
UNION ALL SELECT 'schema_snapshot', 'success', NOT any_rows FROM held
UNION ALL SELECT 'marts_snapshot', 'failed', CASE WHEN any_rows THEN NULL END FROM held"""),
    "k09_reconciled_counts": with_marts(f"""
, marts AS ({_each("'{t}' AS table_name, count(*) AS rows", ("dim_date", "dim_customer", "dim_item", "dim_store", "dim_promotion",
                                                            "fact_store_sales", "fact_web_sales", "fact_catalog_sales"))}),
source AS (SELECT 'dim_item' AS table_name, count(*) AS expected_rows FROM part UNION ALL SELECT 'dim_customer', count(*) FROM customer
           UNION ALL SELECT 'dim_store', count(*) FROM supplier UNION ALL SELECT 'fact_store_sales', count(*) FROM lineitem
           UNION ALL SELECT 'dim_nation', count(*) FROM nation)
SELECT table_name, rows, expected_rows,
       CASE WHEN rows = expected_rows THEN 'ok' WHEN rows IS NULL THEN 'missing' WHEN expected_rows IS NULL THEN 'unexpected' ELSE 'mismatch' END AS status
FROM marts FULL JOIN source USING (table_name)"""),
}
assert RELOADED == (199501, 199512)
