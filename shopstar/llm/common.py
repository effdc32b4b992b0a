"""Helpers shared by the operators: session settings, folds, checkpoints, bounded samples."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.session import ensure_checkpoint_dir

# Texts are long: an Arrow batch of this many rows keeps a Python worker at some tens of MB.
ARROW_ROWS = 1000
# A table of at most this many narrow rows may be broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 50_000

# The word separators of the contracts: space and the ASCII controls tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Settings that the operators rely on: a checkpoint folder and small Arrow batches."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def in_fold(id_col: Column | str, n: int, k: int) -> Column:
    """True where the id is in fold ``k`` of ``n``; a null id counts as held out, so nothing is learnt from it."""
    return F.coalesce(fold(id_col, n) == F.lit(k), F.lit(True))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now; by itself it waits for a garbage collection.

    The second round finds what the first one's cleaning has let go.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` are within ``limit``; else leave the join to the planner."""
    return F.broadcast(df) if rows <= limit else df


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, train: Column, per_label: int) -> DataFrame:
    """At most ``per_label`` labelled ids of each of the labels 0 and 1, by a hash of the id: (id, label).

    An id that carries both labels counts as 1; null labels and ids are left out.
    """
    one = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
           .where(train & F.col("__id").isNotNull() & F.col("__label").isin(0, 1))
           .groupBy("__id").agg(F.max("__label").alias("__label")))
    parts = [one.where(F.col("__label") == v).orderBy(F.xxhash64("__id"), "__id").limit(per_label) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def one_per_id(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of every ``__id`` (and ``keys``): the one whose ``__text`` has the smallest hash.

    So an id that fills much of a table weighs no more than another, and a sample of ids bounds the rows.
    """
    return rows.groupBy("__id", *keys).agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns in which nulls count."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])
