"""The registered queries: thin wrappers that apply an operator to its whole table and derive the contracted columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.llm import decontaminate, langid, lm, merkle, mixing, phrases, quality, simhash, tokenfiles, topk, toxicity, urlfilter, warc
from shopstar.llm.common import fold, in_fold, lower_ascii, read
from shopstar.llm.common import prepare as prepare_session
from shopstar.session import shared_path

# The rules of the url filter's contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~in_fold("__id", 5, 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = lm.score(docs, ~in_fold("__id", 5, 1), in_fold("__id", 5, 4))
    return scored.withColumn("held_out", in_fold("doc_id", 5, 1))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, ~in_fold("__id", 4, 2))
    told = langid.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), F.col("langid.lang").alias("lang_pred"),
                       "langid.score", "langid.entropy", "langid.rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~in_fold("__id", 4, 2))
    scored = quality.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score").withColumn(
        "predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read(spark, sf_dir, "pages")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, decision string")
    judged = urlfilter.judge(read(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = {f: F.col(f) for f in merkle.FIELDS}
    lowered = merkle.leaf_digest(fields | {"text": lower_ascii(F.col("text"))})
    claim = F.when(fold("doc_id", 5) == 0, lowered).otherwise(merkle.leaf_digest(fields))
    manifest = merkle.build(docs, shared_path(spark, f"merkle-{uuid.uuid4().hex}"), claim=claim)
    proofs = merkle.prove(manifest, manifest.table("leaves").select("tree", "idx", "id", "claim"))
    folded = proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                           merkle.fold(F.col("claim"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    files = tokenfiles.write(docs, shared_path(spark, f"tokens-{uuid.uuid4().hex}"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = tokenfiles.locate_all(files, docs.select(F.col("doc_id").alias("key")).distinct())
    sums = tokenfiles.scan(files).select("shard", "offset", "n_tokens", tokenfiles.ids_crc32(F.col("ids"), F.col("width")).alias("ids_crc32"))
    return found.join(sums, ["shard", "offset", "n_tokens"]).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top, beside the package

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = [op1_toxicity, op2_simhash, op3_lm_scoring, op4_language_id, op5_quality, op6_warc_derivatives, op7_decontamination,
            op8_mixing, op9_top_k, op10_url_filter, op11_merkle_manifest, op12_token_files,
            op13_phrases, pipeline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        return run
    return {fn.__name__: wrap(fn) for fn in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from shopstar.llm.queries_sql import SQL

    return dict(SQL)
