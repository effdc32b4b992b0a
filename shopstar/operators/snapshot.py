"""Table snapshots: export with a manifest, verify, list, restore.

A snapshot is a folder ``<root>/<snapshot_id>/`` holding one parquet
folder per table and a ``_manifest`` parquet table with one row per
table: row count, an order-free content checksum, the schema as JSON
(the schema-only export, K02), file count and bytes.  Counts and
checksums are computed by Spark over the *written* copy in one
aggregate per table, so verification later repeats exactly the same
computation on what is on disk.
"""

from __future__ import annotations

import datetime as _dt
import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shopstar.operators.layout import PARTITION_COL, write_table
from shopstar.operators.runlog import log_run
from shopstar.sources.paths import delete

MANIFEST = "_manifest"
MANIFEST_SCHEMA = ("snapshot_id string, created_at timestamp, mode string, table_name string, rows bigint, "
                   "checksum decimal(38,0), schema_json string, files bigint, bytes bigint, duration_secs double")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and an order-independent checksum of all column values.

    The checksum is the exact decimal sum of a 64-bit hash of every row,
    so it does not depend on file or partition order.
    """
    # a null leaves the hash as it is, so every column's null marker is hashed with it
    h = F.xxhash64(*[x for c in df.columns for x in (F.col(c), F.col(c).isNull())]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("checksum"))


def _file_stats(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and total size of the data files under ``path`` (file metadata only)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(path).select("length"))
    r = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    return int(r.n), int(r.b)


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, mode: str = "marts",
             snapshot_id: str | None = None, schema_only: bool = False, log_path: str | None = None) -> str:
    """Write each table and the manifest; returns the snapshot folder.

    With ``log_path`` the run is appended to the run log (K06): its type, outcome, size and duration, also when
    it fails.

    ``schema_only=True`` is the schema-only export: the manifest records
    each table's schema and no data is written.
    """
    if log_path:
        return _logged(spark, log_path, f"{'schema' if schema_only else mode}_snapshot", root,
                       lambda: snapshot(spark, tables, root, mode, snapshot_id, schema_only))
    sid = snapshot_id or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    base = f"{root.rstrip('/')}/{sid}"
    created = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = []
    for name, df in tables.items():
        t0 = time.time()
        if schema_only:
            rows.append((sid, created, "schema", name, None, None, df.schema.json(), 0, 0, 0.0))
            continue
        path = f"{base}/{name}"
        write_table(df, path, "errorifexists")
        written = spark.read.parquet(path)
        fp = table_fingerprint(written).first()
        n_files, n_bytes = _file_stats(spark, path)
        rows.append((sid, created, mode, name, int(fp.rows), fp.checksum, written.schema.json(),
                     n_files, n_bytes, round(time.time() - t0, 3)))
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{base}/{MANIFEST}")
    return base


def _logged(spark: SparkSession, log_path: str, kind: str, root: str, run) -> str:
    started, clock = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), time.time()
    try:
        base = run()
    except Exception as ex:
        log_run(spark, log_path, kind, "failed", None, int(time.time() - clock), str(ex)[:200], started)
        raise
    size = read_manifest(spark, base).agg(F.sum("bytes")).first()[0]
    log_run(spark, log_path, kind, "success", size, int(time.time() - clock), base, started)
    return base


def read_manifest(spark: SparkSession, snapshot_path: str) -> DataFrame:
    return spark.read.parquet(f"{snapshot_path.rstrip('/')}/{MANIFEST}")


def verify_snapshot(spark: SparkSession, snapshot_path: str) -> DataFrame:
    """Re-scan every table and compare with the manifest.

    Returns one row per (table, check) with PASS/FAIL: readable, non-empty,
    schema present and equal, row count, checksum.
    """
    base = snapshot_path.rstrip("/")
    results = []
    try:
        manifest = read_manifest(spark, base).collect()  # one row per table
    except Exception as ex:  # no manifest: the snapshot is unusable
        return spark.createDataFrame([("*", "manifest", "FAIL", str(ex)[:200])],
                                     "table_name string, check string, result string, detail string")
    for m in manifest:
        def add(check, ok, detail=""):
            results.append((m.table_name, check, "PASS" if ok else "FAIL", detail))
        if m.mode == "schema":  # schema-only export: the DDL is all there is
            add("schema", bool(m.schema_json))
            continue
        try:
            df = spark.read.parquet(f"{base}/{m.table_name}")
            fp = table_fingerprint(df).first()
        except Exception as ex:
            add("readable", False, str(ex)[:200])
            continue
        add("readable", True)
        add("non_empty", fp.rows > 0, f"{fp.rows} rows")
        add("schema", bool(m.schema_json) and StructType.fromJson(json.loads(m.schema_json)) == df.schema)
        add("row_count", fp.rows == m.rows, f"{fp.rows} vs {m.rows}")
        add("checksum", fp.checksum == m.checksum)
    return spark.createDataFrame(results, "table_name string, check string, result string, detail string")


def verification_passed(report: DataFrame) -> bool:
    """Pass/fail tally of a verification report (the script's exit status)."""
    return report.filter(F.col("result") != "PASS").limit(1).count() == 0


def part_fingerprints(df: DataFrame) -> DataFrame:
    """Rows and checksum of every part of a table: its month folders, else the table as one part ``all``."""
    part = F.coalesce(F.col(PARTITION_COL).cast("string"), F.lit("undated")) if PARTITION_COL in df.columns else F.lit("all")
    h = F.xxhash64(*[x for c in df.columns for x in (F.col(c), F.col(c).isNull())]).cast("decimal(20,0)")
    return df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("decimal(38,0)").alias("checksum"))


def damaged_parts(spark: SparkSession, snapshot_path: str, live_root: str, tables=None) -> DataFrame:
    """The parts of live tables that differ from the snapshot: (table_name, part, state).

    ``missing``: not in the live table; ``unexpected``: only there; ``rows`` or ``content``: another number of rows, or
    other values.  A live table that cannot be read counts as missing in all its parts.
    """
    base, out = snapshot_path.rstrip("/"), None
    for m in read_manifest(spark, base).collect():  # one row a table
        if tables is not None and m.table_name not in tables:
            continue
        kept = part_fingerprints(spark.read.parquet(f"{base}/{m.table_name}"))
        try:
            live = part_fingerprints(spark.read.parquet(f"{live_root.rstrip('/')}/{m.table_name}"))
        except AnalysisException:
            live = kept.where("false")
        live = live.select("part", F.col("rows").alias("live_rows"), F.col("checksum").alias("live_checksum"))
        state = (F.when(F.col("live_rows").isNull(), "missing").when(F.col("rows").isNull(), "unexpected")
                 .when(F.col("rows") != F.col("live_rows"), "rows").when(F.col("checksum") != F.col("live_checksum"), "content"))
        found = kept.join(live, "part", "full_outer").select(F.lit(m.table_name).alias("table_name"), "part", state.alias("state"))
        out = found if out is None else out.unionByName(found)
    return out.where("state is not null")


def repair(spark: SparkSession, snapshot_path: str, live_root: str, tables=None) -> list[tuple[str, str, str]]:
    """K05 for damaged parts only: month folders that differ are written from the snapshot, the others stay untouched.

    A table without month folders is one part and is restored whole.  Returns what was repaired.
    """
    base, live_root = snapshot_path.rstrip("/"), live_root.rstrip("/")
    report = verify_snapshot(spark, base)
    if not verification_passed(report):
        raise ValueError(f"snapshot {base} failed verification")
    found = [(r.table_name, r.part, r.state) for r in damaged_parts(spark, base, live_root, tables).collect()]  # at most a row a month
    for table in sorted({t for t, _, _ in found}):
        parts = {p: state for t, p, state in found if t == table}
        source, target = spark.read.parquet(f"{base}/{table}"), f"{live_root}/{table}"
        if PARTITION_COL not in source.columns:
            write_table(source, target)
            continue
        wanted = [int(p) for p, state in parts.items() if state != "unexpected" and p != "undated"]
        month = F.col(PARTITION_COL)
        undated = parts.get("undated", "unexpected") != "unexpected"
        rows = source.where(month.isin(wanted) | month.isNull() if undated else month.isin(wanted))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION_COL).parquet(target)
        for p, state in parts.items():
            if state == "unexpected":
                delete(spark, f"{target}/{PARTITION_COL}={'__HIVE_DEFAULT_PARTITION__' if p == 'undated' else p}")
    return sorted(found)


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Every snapshot under ``root``, newest first, with mode, tables, rows and size."""
    try:
        m = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root.rstrip('/')}/*/{MANIFEST}")
    except AnalysisException:  # no snapshot yet
        m = spark.createDataFrame([], MANIFEST_SCHEMA)
    return (m.groupBy("snapshot_id", "created_at", "mode")
            .agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
            .orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc()))


def restore(spark: SparkSession, snapshot_path: str, target_root: str, tables=None,
            dry_run: bool = True, confirm: bool = False) -> DataFrame:
    """Plan (and on ``confirm`` perform) the restore of a snapshot.

    The snapshot is verified first; the plan lists each table with its
    source, target and expected rows.  Nothing is written unless
    ``dry_run`` is False *and* ``confirm`` is True; then each target is
    overwritten from the snapshot copy.
    """
    base = snapshot_path.rstrip("/")
    report = verify_snapshot(spark, base)
    if not verification_passed(report):
        raise ValueError(f"snapshot {base} failed verification")
    manifest = read_manifest(spark, base).collect()
    if any(m.mode == "schema" for m in manifest):
        raise ValueError(f"snapshot {base} is a schema-only export; it holds no data to restore")
    chosen = [m for m in manifest if tables is None or m.table_name in tables]
    act = not dry_run and confirm
    plan = []
    for m in chosen:
        target = f"{target_root.rstrip('/')}/{m.table_name}"
        if act:
            write_table(spark.read.parquet(f"{base}/{m.table_name}"), target)
        plan.append((m.table_name, f"{base}/{m.table_name}", target, int(m.rows),
                     "restored" if act else "would overwrite"))
    return spark.createDataFrame(plan, "table_name string, source string, target string, rows bigint, action string")


def reconcile_counts(actual: DataFrame, expected: DataFrame, tolerance_pct: float = 0.0) -> DataFrame:
    """Join actual row counts (table_name, rows) with expectations (table_name, expected_rows)."""
    j = actual.join(expected, "table_name", "full_outer")
    diff = F.abs(F.col("rows") - F.col("expected_rows"))
    ok = (F.col("rows").isNotNull() & F.col("expected_rows").isNotNull()
          & (diff <= F.col("expected_rows") * F.lit(tolerance_pct / 100.0)))
    return j.select("table_name", "rows", "expected_rows",
                    F.when(ok, "ok").when(F.col("rows").isNull(), "missing")
                    .when(F.col("expected_rows").isNull(), "unexpected").otherwise("mismatch").alias("status"))
