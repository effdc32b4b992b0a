"""Append ledger of landed files (S11): every file is recorded with a fingerprint and a load id.

A load lands what the ledger does not hold yet.  Files are compared by their
rows, not by their names: a fingerprint is the number of lines, of characters
and an order-free sum of line hashes, aggregated by Spark over the text (map-side
partials, one row a file), so no file has to fit a task.

* ``new``: rows that no earlier load landed; landed.
* ``known``: the same rows were landed before (under whatever name) or come twice
  in this load; skipped.
* ``changed``: the name was landed before with other rows; reported, not landed,
  until the caller says ``replace=True``; then the new rows count and the old
  ones do not.

Each load writes a folder of its own and the ledger last, and readers take only
files that the ledger holds: a load that dies leaves nothing behind that is read.
Empty files have no rows and no entry.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shopstar.sources import delimited as D
from shopstar.sources.paths import exists
from shopstar.sources.schemas import raw_schema

NEW, KNOWN, CHANGED = "new", "known", "changed"
ENTRY = "load_id string, seq bigint, file string, lines bigint, chars bigint, checksum decimal(38,0), state string"
CONTENT = ["lines", "chars", "checksum"]
FILE = "_source_file"


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, chars, checksum) of every file below ``path`` that has lines; ``file`` is its name."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")
    return (lines.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("value").cast("bigint")).alias("chars"),
        F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("checksum"))
        .withColumn("file", F.element_at(F.split("file_path", "/"), -1)))


class Ledger:
    """The landed files of one raw table below ``out_dir``."""

    def __init__(self, spark: SparkSession, out_dir: str, table: str):
        self.spark, self.table = spark, table
        self.dir = f"{out_dir.rstrip('/')}/{table}"

    def entries(self) -> DataFrame:
        """All entries of all loads."""
        path = f"{self.dir}/_ledger"
        return self.spark.read.schema(ENTRY).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], ENTRY)

    def held(self) -> DataFrame:
        """The files whose rows count: the last landed content of every name."""
        w = Window.partitionBy("file").orderBy(F.desc("seq"))
        landed = self.entries().where(F.col("state") == NEW)
        return landed.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

    def compare(self, path: str, replace: bool = False) -> DataFrame:
        """(file_path, file, lines, chars, checksum, state) of the files below ``path``."""
        found, held = fingerprints(self.spark, path), self.held()
        # the same rows twice in one load: the first name counts
        w = Window.partitionBy(*CONTENT).orderBy("file", "file_path")
        found = found.withColumn("copy", F.row_number().over(w))
        content = held.select(*CONTENT, F.lit(True).alias("same")).distinct()
        names = held.select("file", F.lit(True).alias("named")).distinct()
        j = found.join(content, CONTENT, "left").join(names, "file", "left")
        state = (F.when(F.col("same") | (F.col("copy") > 1), KNOWN).when(F.col("named"), NEW if replace else CHANGED).otherwise(NEW))
        return j.select("file_path", "file", *CONTENT, state.alias("state"))

    def load(self, src_dir: str, load_id: str | None = None, replace: bool = False) -> DataFrame:
        """Land the new files of ``src_dir`` and record the load; returns its entries.  A missing source lands nothing."""
        load_id = load_id or uuid.uuid4().hex
        if not re.fullmatch("[A-Za-z0-9_.-]+", load_id):
            raise ValueError("a load id is made of letters, digits, '_', '.' and '-'")
        path = D.source_path(src_dir, self.table)
        if not exists(self.spark, path):
            D.log.warning("source file for %s not found at %s; skipped", self.table, path)
            return self.spark.createDataFrame([], ENTRY)
        past = self.entries().agg(F.max("seq").alias("last"), F.count(F.when(F.col("load_id") == load_id, 1)).alias("own")).first()
        if past["own"]:
            raise ValueError(f"load {load_id} is in the ledger of {self.table} already")
        files = self.compare(path, replace).collect()  # one row a file of this load, as a file listing
        fresh = [r["file_path"] for r in files if r["state"] == NEW]
        if fresh:
            schema = raw_schema(self.table)
            rows = D.scan_delimited(self.spark, fresh, schema)
            named = rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias(FILE))
            (D.classify_rows(named, schema, [FILE]).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(D.STATUS)
             .parquet(f"{self.dir}/loads/load_id={load_id}"))  # replaces what a load of this id that died has left
        seq = (past["last"] or 0) + 1
        return self._record([(load_id, seq, r["file"], r["lines"], r["chars"], r["checksum"], r["state"]) for r in files])

    def _record(self, rows: list[tuple]) -> DataFrame:
        entries = self.spark.createDataFrame(rows, ENTRY)
        if rows:
            entries.coalesce(1).write.mode("append").parquet(f"{self.dir}/_ledger")
        return entries

    def read(self) -> DataFrame:
        """The accepted rows of all files that count, with the declared schema."""
        schema, path = raw_schema(self.table), f"{self.dir}/loads"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        extra = [StructField(c, StringType()) for c in (FILE, "load_id", D.STATUS)]
        rows = self.spark.read.schema(StructType([*schema.fields, *extra])).parquet(path).where(F.col(D.STATUS) == D.ACCEPTED)
        counted = self.held().select("load_id", F.col("file").alias(FILE))
        return rows.join(counted, ["load_id", FILE], "left_semi").select(*schema.names)
