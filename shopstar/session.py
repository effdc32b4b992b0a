"""Spark session helpers.

Every job in the package takes a ``SparkSession`` from the caller; these
helpers only cover the two things the library needs to agree on with the
cluster: the settings that keep decimal and date results reproducible,
and the shared folder used to cut lineage (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the results depend on (UTC dates, ANSI arithmetic) plus the
# adaptive-execution switches the plans are written for.
RESULT_CONF = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dimensions below this estimated size are broadcast by the planner;
    # anything larger falls back to a sort-merge join (size-checked broadcast).
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # The planner estimates a scan from its files, and Parquet's are several times
    # smaller than their rows: without this, millions of keys pass as a small dimension
    # and are collected by the driver.  Adaptive execution knows the rows' real size and
    # still turns a join with a small side into a broadcast.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "shopstar") -> SparkSession:
    """Local session for tests, tools and the bench (UI off)."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Apply the package's settings to a session made elsewhere; settings that results depend on must take."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    wrong = {k: spark.conf.get(k) for k in RESULT_CONF if spark.conf.get(k) != SESSION_CONF[k]}
    if wrong:
        raise RuntimeError(f"these settings change results and did not take: {wrong}")


def sibling(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session on the same cluster and catalog with the settings of ``spark`` and those of ``conf``."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **conf}.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the operator and read from the
    session.  Only a local session (one machine, as in tests) may leave it
    unset and gets a scratch folder; anywhere else that is an error, since
    executors on other hosts would not see a folder of this machine.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="shopstar-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts) if "://" not in base else "/".join([base.rstrip("/"), *parts])


def cluster_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run (the local defaults do not scale).

    * scan splits of 256 MB keep per-task parquet reads efficient;
    * the initial shuffle partition count is sized so that a full-volume
      exchange lands near 256 MB per partition (at least 2 waves of tasks),
      and AQE coalesces small exchanges by bytes (``parallelismFirst`` off)
      instead of keeping one partition per core;
    * skew-join splitting stays on for partitions 5x the median.
    """
    target = 256 * 1024 * 1024
    partitions = max(2 * cores, -(-input_bytes // target))
    return {
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
