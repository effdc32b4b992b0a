"""Pipe-delimited source files: scan, row classification, landing.

File form: one ``<table>.dat`` (or a folder of parts) per table, ``|``
separated, no header, no quoting, empty field = NULL; generators may strip
the trailing delimiter, so trailing NULL columns can be missing.

Everything runs in the CSV reader (PERMISSIVE mode) plus column
expressions: the reader pads short rows with NULLs and flags every row it
had to repair, type or length problems included, in a corrupt-record
column; the flag is then refined by counting the row's tokens:

* fewer tokens than columns -> accepted (padded with NULLs),
* exactly one surplus token that is empty -> accepted (trailing ``|``),
* any other surplus -> rejected,
* a non-empty token that did not parse to its declared type -> rejected,
* a string longer than its declared CHAR/VARCHAR length -> rejected.

CHAR columns are right-trimmed at ingest (blank-padded CHAR semantics).
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shopstar.sources.paths import exists
from shopstar.sources.schemas import LOAD_ORDER, raw_schema

log = logging.getLogger(__name__)

CORRUPT = "_corrupt_record"
STATUS = "_load_status"
REASON = "_reject_reason"
ACCEPTED, REJECTED = "accepted", "rejected"
NO_QUOTE = "\u0001"  # a character that never occurs: quoting disabled


def source_path(src_dir: str, table: str) -> str:
    return f"{src_dir.rstrip('/')}/{table}.dat"


def scan_delimited(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Typed scan of pipe-delimited files with the repair flag column."""
    with_flag = StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
    return (spark.read.schema(with_flag)
            .option("sep", "|").option("quote", NO_QUOTE).option("escape", NO_QUOTE)
            .option("nullValue", "").option("header", "false")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .csv(path))


def classify_rows(df: DataFrame, schema: StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Add ``_load_status`` and ``_reject_reason``; rtrim CHAR columns.  Columns ``keep`` stay as they are."""
    n = len(schema.fields)
    tokens = F.split(F.col(CORRUPT), r"\|", -1)
    ntok = F.size(tokens)
    surplus_ok = (ntok == n + 1) & (F.element_at(tokens, n + 1) == "")
    too_long_row = F.col(CORRUPT).isNotNull() & (ntok > n) & ~surplus_ok

    type_errors: list[Column] = []
    for i, f in enumerate(schema.fields):
        if isinstance(f.dataType, StringType):
            continue
        tok = F.when(ntok > i, F.element_at(tokens, i + 1))
        type_errors.append(F.col(CORRUPT).isNotNull() & (F.coalesce(tok, F.lit("")) != "") & F.col(f.name).isNull())
    bad_type = F.lit(False)
    for e in type_errors:
        bad_type = bad_type | e

    cols = []
    length_errors: list[Column] = []
    for f in schema.fields:
        c = F.col(f.name)
        if f.metadata.get("blank_padded"):
            c = F.rtrim(c)
        if "max_length" in f.metadata:
            length_errors.append(F.coalesce(F.char_length(c) > f.metadata["max_length"], F.lit(False)))
        cols.append(c.alias(f.name))
    too_wide = F.lit(False)
    for e in length_errors:
        too_wide = too_wide | e

    reason = (F.when(too_long_row, "surplus columns").when(bad_type, "type or range")
              .when(too_wide, "string too long"))
    return df.select(*cols, *keep, reason.alias(REASON)).withColumn(
        STATUS, F.when(F.col(REASON).isNull(), ACCEPTED).otherwise(REJECTED))


def read_raw(spark: SparkSession, src_dir: str, table: str) -> DataFrame | None:
    """Scan + classify one source table; ``None`` (with a notice) when the file is missing."""
    schema = raw_schema(table)
    path = source_path(src_dir, table)
    try:
        df = scan_delimited(spark, path, schema)
    except AnalysisException as ex:
        if "PATH_NOT_FOUND" in str(ex) or "Path does not exist" in str(ex):
            log.warning("source file for %s not found at %s; skipped", table, path)
            return None
        raise
    return classify_rows(df, schema)


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(STATUS) == ACCEPTED).drop(STATUS, REASON)


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col(STATUS) == REJECTED)


def land_raw(spark: SparkSession, src_dir: str, table: str, out_dir: str, mode: str = "append") -> str | None:
    """One pass over the file, written partitioned by load status.

    Accepted rows land in ``<out>/<table>/_load_status=accepted`` (the raw
    layer, append-only by default), rejects beside them with a reason, so
    the source is scanned once.  Returns the table folder or ``None``.
    """
    df = read_raw(spark, src_dir, table)
    if df is None:
        return None
    dest = f"{out_dir.rstrip('/')}/{table}"
    df.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(STATUS).parquet(dest)
    return dest


def read_landed(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """The accepted rows of a landed raw table with the declared schema."""
    path = f"{raw_dir.rstrip('/')}/{table}/{STATUS}={ACCEPTED}"
    schema = raw_schema(table)
    if not exists(spark, path):  # every row was rejected
        return spark.createDataFrame([], schema)
    df = spark.read.schema(StructType(list(schema.fields) + [StructField(REASON, StringType())])).parquet(path)
    return df.select(*[f.name for f in schema.fields])


def load_all(spark: SparkSession, src_dir: str, out_dir: str, tables=LOAD_ORDER, mode: str = "append") -> dict:
    """Land every table of the registry (dimensions first, then facts).

    Without foreign keys the order carries no meaning for correctness; it
    only mirrors the source runbook.  Missing files are skipped (S04).
    """
    done = {}
    for t in tables:
        done[t] = land_raw(spark, src_dir, t, out_dir, mode)
    return done


def load_report(spark: SparkSession, raw_dir: str, tables=LOAD_ORDER, schema_name: str = "raw") -> DataFrame:
    """Exact row counts per landed table, largest first."""
    parts = []
    for t in tables:
        p = f"{raw_dir.rstrip('/')}/{t}/{STATUS}={ACCEPTED}"
        if not exists(spark, p):
            continue
        parts.append(spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(schema_name).alias("schema"), F.lit(t).alias("table"), "rows"))
    if not parts:
        return spark.createDataFrame([], "schema string, `table` string, rows bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("rows").desc(), "table")
