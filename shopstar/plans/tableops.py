"""Table operations run on the given tables: load, reload, snapshot, verify, restore, log.

Each registered report does the operation for real below the shared checkpoint
folder (a new folder a run) and returns what is there afterwards.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shopstar.operators import layout as L
from shopstar.operators import snapshot as S
from shopstar.operators.marts import DIM_KEYS, FACT_TABLES, at_once, staged_lines
from shopstar.operators.versions import VersionedFact
from shopstar.plans.tables import mart_row_counts
from shopstar.session import shared_path
from shopstar.sources import delimited as D
from shopstar.sources.ledger import Ledger

SNAPSHOT_TABLES = (*DIM_KEYS, *FACT_TABLES)
RELOADED = (199501, 199512)
LOST, CHANGED = 199603, 199604


def _folder(m) -> str:
    return shared_path(m.spark, "tableops", uuid.uuid4().hex)


def _source_files(m, folder: str, *parities: int) -> None:
    """Delimited ``reason`` files from the parts: a part's key decides what is wrong with its row.

    Last digit 0: trailing delimiter; 1: last column missing; 2: a surplus column; 3: a key that is no number;
    4: an id longer than declared; others as declared.
    """
    k = F.col("p_partkey")
    digit, key = k % 10, k.cast("string")
    row = (F.when(digit == 0, F.concat(key, F.lit("|R"), key, F.lit("|"), "p_name", F.lit("|")))
           .when(digit == 1, F.concat(key, F.lit("|R"), key))
           .when(digit == 2, F.concat(key, F.lit("|R"), key, F.lit("|"), "p_name", F.lit("|more")))
           .when(digit == 3, F.concat(F.lit("x"), key, F.lit("|R"), key, F.lit("|"), "p_name"))
           .when(digit == 4, F.concat(key, F.lit("|a reason id that is long"), key, F.lit("|"), "p_name"))
           .otherwise(F.concat(key, F.lit("|R"), key, F.lit("   |"), "p_name")))
    for parity in parities:
        m.t.part.filter(k % 2 == parity).select(row).write.text(f"{folder}/src{parity}/reason.dat")


def load_status(m) -> DataFrame:
    """Rows accepted and rejected, by reason."""
    folder = _folder(m)
    _source_files(m, folder, 0, 1)
    parts = [D.read_raw(m.spark, f"{folder}/src{p}", "reason") for p in (0, 1)]
    return (parts[0].unionByName(parts[1]).groupBy(F.col(D.STATUS).alias("load_status"), F.col(D.REASON).alias("reason"))
            .agg(F.count(F.lit(1)).alias("rows")))


def landed_rows(m) -> DataFrame:
    """Two loads appended (a table without a file is skipped); the accepted rows."""
    folder = _folder(m)
    _source_files(m, folder, 0, 1)
    for p in (0, 1):
        D.load_all(m.spark, f"{folder}/src{p}", f"{folder}/raw", ["income_band", "reason"])
    return D.read_landed(m.spark, f"{folder}/raw", "reason")


def ledger_loads(m) -> DataFrame:
    """One half landed, then both halves, then both again: what each load took and skipped, and the rows that count."""
    folder = _folder(m)
    _source_files(m, folder, 0, 1)
    ledger = Ledger(m.spark, f"{folder}/raw", "reason")
    for load_id, parity in (("first", 0), ("again", 0), ("second", 1), ("last", 1)):
        ledger.load(f"{folder}/src{parity}", load_id)
    taken = ledger.entries().groupBy("load_id", "state").agg(F.sum("lines").alias("lines"))
    return taken.withColumn("rows_that_count", F.lit(ledger.read().count()).cast("bigint"))


def load_report(m) -> DataFrame:
    """S06 over the raw layer: exact rows of each landed table."""
    folder = _folder(m)
    _source_files(m, folder, 0, 1)
    for p in (0, 1):
        D.load_all(m.spark, f"{folder}/src{p}", f"{folder}/raw", ["income_band", "reason"])
    return D.load_report(m.spark, f"{folder}/raw", ["income_band", "reason"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _named(table: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), "*")


def reloaded_months(m) -> DataFrame:
    """The facts published, one year loaded again without its March; their month folders."""
    folder = _folder(m)
    with staged_lines(m, folder) as lines:
        def load(t):
            key = L.FACT_DATE_KEY[t]
            fact, ym = VersionedFact(m.spark, f"{folder}/{t}", key), L.sold_ym(key)
            fact.publish(getattr(lines, t))
            fact.publish(getattr(lines, t).filter(ym.between(*RELOADED) & (ym != 199503)), RELOADED)
            return fact.read()
        facts = at_once(load, FACT_TABLES)
    return _union([_named(t, L.partition_report(fact, L.FACT_DATE_KEY[t])) for t, fact in zip(FACT_TABLES, facts, strict=True)])


def undated_partition(m) -> DataFrame:
    """Sales without a date (every 13th ticket or order here) are written to the default partition."""
    folder, out = _folder(m), []
    with staged_lines(m, folder) as lines:
        def write(t):
            key = L.FACT_DATE_KEY[t]
            number = f"{key[:2]}_{'ticket' if t == 'fact_store_sales' else 'order'}_number"
            L.write_fact(getattr(lines, t).withColumn(key, F.when(F.col(number) % 13 != 0, F.col(key))), f"{folder}/{t}", key)
        at_once(write, FACT_TABLES)
    for t, key in L.FACT_DATE_KEY.items():
        out.append(_named(t, L.partition_report(L.read_fact(m.spark, f"{folder}/{t}"), key)))
    return _union(out)


def table_statistics(m) -> DataFrame:
    """Row counts that ANALYZE keeps in the catalog for all marts (registered under names of their own, then dropped)."""
    folder, tag = _folder(m), uuid.uuid4().hex[:12]
    with staged_lines(m, folder) as lines:
        def write(t):
            if t in L.FACT_DATE_KEY:
                L.write_fact(getattr(lines, t), f"{folder}/{t}", L.FACT_DATE_KEY[t])
            else:
                getattr(m, t).write.parquet(f"{folder}/{t}")
        at_once(write, SNAPSHOT_TABLES)

    def statistics(t):
        name = f"{t}_{tag}"
        L.register_table(m.spark, name, f"{folder}/{t}", t in L.FACT_DATE_KEY)
        stats = L.analyze_table(m.spark, name).first()["data_type"]  # one line of text
        m.spark.sql(f"DROP TABLE {name}")
        return t, stats
    out = at_once(statistics, SNAPSHOT_TABLES)
    rows = m.spark.createDataFrame(out, "table_name string, statistics string")
    return rows.select("table_name", F.regexp_extract("statistics", "([0-9]+) rows", 1).cast("bigint").alias("rows"))


def _snapshot(m, folder: str, **kw) -> str:
    if kw.get("schema_only"):  # nothing is written
        return S.snapshot(m.spark, {t: getattr(m, t) for t in SNAPSHOT_TABLES}, f"{folder}/snapshots", **kw)
    with staged_lines(m, folder) as lines:
        return S.snapshot(m.spark, {t: getattr(lines if t in FACT_TABLES else m, t) for t in SNAPSHOT_TABLES}, f"{folder}/snapshots", **kw)


def manifest(m) -> DataFrame:
    """The tables of a snapshot with their rows."""
    return S.read_manifest(m.spark, _snapshot(m, _folder(m))).select("table_name", "mode", "rows", (F.col("bytes") > 0).alias("has_data"))


def schema_export(m) -> DataFrame:
    """Columns of each table in a schema-only export, and the rows of the mart that a table made from it takes."""
    out = S.read_manifest(m.spark, _snapshot(m, _folder(m), schema_only=True))
    parts = []
    for r in out.select("table_name", "mode", "schema_json").collect():  # one row a table
        made = m.spark.createDataFrame([], StructType.fromJson(json.loads(r.schema_json)))
        mart = getattr(m, r.table_name)
        fits = made.union(mart.select(*[F.col(f.name).cast(f.dataType) for f in made.schema.fields]))
        parts.append(fits.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(r.table_name).alias("table_name"), F.lit(r.mode).alias("mode"), F.lit(len(made.columns)).alias("columns"), "rows"))
    return _union(parts)


def verification(m) -> DataFrame:
    """Every check of a snapshot on what was written."""
    return S.verify_snapshot(m.spark, _snapshot(m, _folder(m))).select("table_name", "check", "result")


def snapshots(m) -> DataFrame:
    """Two snapshots listed, newest first."""
    folder = _folder(m)
    for name in ("first", "second"):
        _snapshot(m, folder, snapshot_id=name)
    return S.list_snapshots(m.spark, f"{folder}/snapshots").select("snapshot_id", "mode", "tables", "rows")


def restored(m) -> DataFrame:
    """What a confirmed restore wrote: rows of each table, counted from the target."""
    folder = _folder(m)
    plan = S.restore(m.spark, _snapshot(m, folder), f"{folder}/back", dry_run=False, confirm=True)
    return _union([_named(r.table_name, m.spark.read.parquet(r.target).agg(F.count(F.lit(1)).alias("rows"))) for r in plan.collect()])


def damaged_months(m) -> DataFrame:
    """Live facts of which a month was lost and another changed: what is found, and what is left after the repair."""
    folder = _folder(m)
    live = f"{folder}/live"
    with staged_lines(m, folder) as lines:
        snap = S.snapshot(m.spark, {t: _by_month(lines, t) for t in FACT_TABLES}, f"{folder}/snapshots")

    def damage(t):
        number = f"{L.FACT_DATE_KEY[t][:2]}_{'ticket' if t == 'fact_store_sales' else 'order'}_number"
        ym, rows = F.col(L.PARTITION_COL), m.spark.read.parquet(f"{snap}/{t}")
        changed = F.when(ym == CHANGED, F.col(number) + 1).otherwise(F.col(number))
        L.write_table(rows.where(ym != LOST).withColumn(number, changed), f"{live}/{t}")
    at_once(damage, FACT_TABLES)
    found = S.repair(m.spark, snap, live)
    left = {(r.table_name, r.part) for r in S.damaged_parts(m.spark, snap, live).collect()}
    rows = [(t, p, state, (t, p) not in left) for t, p, state in found]  # at most a row a month
    return m.spark.createDataFrame(rows, "table_name string, part string, state string, repaired boolean")


def _by_month(m, t: str) -> DataFrame:
    return getattr(m, t).withColumn(L.PARTITION_COL, L.sold_ym(L.FACT_DATE_KEY[t]))


def logged_runs(m) -> DataFrame:
    """The run log after a snapshot, an export and a failed run (the same snapshot id twice)."""
    folder = _folder(m)
    log = f"{folder}/log"
    _snapshot(m, folder, snapshot_id="one", log_path=log)
    _snapshot(m, folder, snapshot_id="two", log_path=log, schema_only=True)
    try:
        _snapshot(m, folder, snapshot_id="one", log_path=log)
    except Exception as ex:  # the folder is there already; any other trouble is an error
        if "already exists" not in str(ex):
            raise
    return m.spark.read.parquet(log).select("backup_type", "status", (F.col("size_bytes") > 0).alias("has_size"))


def reconciled(m) -> DataFrame:
    """Counts of the marts against counts of the source rows they are made of."""
    t = m.t
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("expected_rows")).select(F.lit(name).alias("table_name"), "expected_rows")
    expected = n(t.part, "dim_item").unionByName(n(t.customer, "dim_customer")).unionByName(n(t.supplier, "dim_store"))
    expected = expected.unionByName(n(t.lineitem, "fact_store_sales")).unionByName(n(t.nation, "dim_nation"))
    return S.reconcile_counts(mart_row_counts(m).select("table_name", "rows"), expected)


def registry(on):
    return {
        "s01_load_status": on(load_status), "s06_raw_load_report": on(load_report), "s10_reloaded_months": on(reloaded_months),
        "s11_landed_rows": on(landed_rows), "s11_ledger_loads": on(ledger_loads), "s16_undated_partition": on(undated_partition), "s18_table_statistics": on(table_statistics),
        "k01_manifest": on(manifest), "k02_schema_export": on(schema_export), "k03_verification": on(verification),
        "k04_snapshots": on(snapshots), "k05_restored_rows": on(restored), "k06_logged_runs": on(logged_runs),
        "k03_damaged_months": on(damaged_months), "k09_reconciled_counts": on(reconciled),
    }
