"""Corpus pipeline: five stages over ``documents``, each one operator of ``shopstar.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  Stages 1 to 4 return the
columns of ``docs``; the last adds ``copies`` (``copies_`` and so on where the
table has that name): how often the mix takes the document (documents that it
leaves out go).

Every stage learns from and decides on what its predecessor kept.  Cases: the
operators' own (see their modules); an empty table passes through every stage;
further columns stay, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.llm import decontaminate, langid, mixing, quality, simhash
from shopstar.llm.common import in_fold, prepare, read
from shopstar.operators.ranking import unused
from shopstar.session import shared_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    prepare(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~in_fold("__id", 4, 2))
    name, = unused(docs, "__quality")
    return quality.score(docs, model, out=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like none of the languages learnt go."""
    prepare(spark)
    name, = unused(docs, "__langid")
    told = langid.predict(docs, langid.fit(docs, ~in_fold("__id", 4, 2)), out=name)
    return told.where(~F.col(f"{name}.rejected")).drop(name)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    prepare(spark)
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of ``copies``."""
    prepare(spark)
    return mixing.sample(docs, out=unused(docs, "copies")[0])


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", dedup_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

# The classifiers, fingerprints and templates cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared checkpoint folder and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    folder = f"pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = shared_path(spark, folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
