"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every source gets a word budget: its weight's share of ``total_share`` times all
words, cut at ``max_repeats`` times the source's own size, the excess going to
the other sources by weight until none is above its limit.  A budget is met by
whole documents: as many full passes over the source as fit, then one more pass
over the documents whose hash is below a threshold.  The threshold comes from a
histogram of words by source and hash bucket; only the boundary bucket is split
again, by the next bits of the hash, until it is down to single hash values.
Nothing is sorted and no document is compared with another.

Cases: a null text has size 0; a null source is a source of its own, after all
others; sources of size 0 have target 0; documents of size 0 are taken 0; rows
that repeat an id share its hash and are taken or left together; an empty table
gives an empty result; further columns stay in ``sample``, whatever their names.
"""

from __future__ import annotations

import decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopstar.llm.common import WORD_PATTERN, cut, small
from shopstar.operators.ranking import unused

HASH_DIGITS = 15  # hex digits of the md5 that order the documents (60 bits)
LEVEL_BITS = 12  # hash bits that one histogram resolves


def text_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def id_hash(id_col: Column) -> Column:
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """A non-null key in code-point order with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_table(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(__key, source_size, weight): one row a source; the rank is counted per range partition, then offset."""
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = (sized.groupBy("__key").agg(F.sum("__size").alias("source_size"))
            .repartitionByRange(parts, "__key").withColumn("__part", F.spark_partition_id()))
    sums = cut(sums)
    before = (sums.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__before", F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
              .select("__part", F.coalesce("__before", F.lit(0)).alias("__before")))
    ranked = sums.withColumn("__row", F.row_number().over(W.partitionBy("__part").orderBy("__key")))
    place = (F.col("__before") + F.col("__row") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    return ranked.join(small(before, parts), "__part").select("__key", "source_size", weight.alias("weight"))


def targets(sources: DataFrame, total_share: decimal.Decimal, max_repeats: int) -> DataFrame:
    """Add ``target``: weight shares of the total, cut at the limit, the excess reshared until none is above.

    Each round sums the limits of the sources that are cut and the weights of the others (one row to the
    driver); a source that is cut stays cut, so the rounds end.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = float(decimal.Decimal(total) * total_share)
    limit = (F.col("source_size") * max_repeats).cast("double")
    per_weight = None
    while True:
        cut_off = F.lit(False) if per_weight is None else F.col("weight") * F.lit(per_weight) > limit
        row = sources.agg(F.sum(F.when(cut_off, limit)).alias("cut"), F.sum(F.when(~cut_off, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            break
        new = (budget - (row["cut"] or 0.0)) / row["free"]
        if per_weight is not None and new <= per_weight:
            break
        per_weight = new
    share = F.col("weight") * F.lit(float(per_weight or 0.0))
    return sources.withColumn("target", F.least(share, limit))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), total_share: str = "1.5", max_repeats: int = 2) -> DataFrame:
    """One row a document: its id, ``size``, ``source``, ``source_size``, ``target`` and ``taken`` words."""
    sized = cut(docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), _key(F.col(source_col)).alias("__key"),
        text_words(F.col(text_col)).alias("__size"), id_hash(F.col(id_col)).alias("__hash")))
    sources = cut(targets(source_table(sized, weights), decimal.Decimal(total_share), max_repeats))
    n = sources.count()
    bounds = thresholds(sized, sources, n)
    out = sized.join(small(bounds, n), "__key", "left")
    taken = F.col("__size") * (F.col("__passes") + F.when(F.col("__hash") < F.col("__threshold"), 1).otherwise(0))
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("__size").alias("size"),
                      "source_size", "target", taken.cast("long").alias("taken"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: tuple[int, ...] = (5, 2, 1), total_share: str = "1.5", max_repeats: int = 2, out: str = "copies") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with the number of times (``out``, a new column); the others go.

    Copies depend on the source and the id's hash alone, so no text is joined; documents without words go.
    """
    sized = cut(docs.select(F.col(id_col).alias("__id"), _key(F.col(source_col)).alias("__key"),
                            text_words(F.col(text_col)).alias("__size"), id_hash(F.col(id_col)).alias("__hash")))
    sources = cut(targets(source_table(sized, weights), decimal.Decimal(total_share), max_repeats))
    n = sources.count()
    key, place, passes, limit = unused(docs, "__key", "__hash", "__passes", "__threshold")
    bounds = thresholds(sized, sources, n).select(F.col("__key").alias(key), F.col("__passes").alias(passes), F.col("__threshold").alias(limit))
    marked = docs.withColumn(key, _key(F.col(source_col))).withColumn(place, id_hash(F.col(id_col)))
    copies = F.col(passes) + F.when(F.col(place) < F.col(limit), 1).otherwise(0)
    words = F.regexp_like(F.col(text_col), F.lit(WORD_PATTERN))
    return (marked.join(small(bounds, n), key).withColumn(out, copies.cast("int")).where((F.col(out) > 0) & words)
            .drop(key, place, passes, limit))


def thresholds(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Add ``__passes`` (whole passes) and ``__threshold``: hashes below it are taken once more.

    The words below the threshold come as near to the rest of the budget as whole hash values allow.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = (sources.withColumn("__passes", passes.cast("long"))
             .withColumn("__rest", F.col("target") - F.col("__passes") * F.col("source_size"))
             .withColumn("__prefix", F.lit(0).cast("long")).withColumn("__below", F.lit(0).cast("long"))
             .withColumn("__last", F.lit(0).cast("long")))
    bits = 4 * HASH_DIGITS
    for low in range(bits - LEVEL_BITS, -1, -LEVEL_BITS):
        state = cut(_refine(sized, state, n_sources, low))
    # the last boundary value is one hash: take it if that comes nearer to the budget
    over = (F.col("__below") + F.col("__last") - F.col("__rest")) < (F.col("__rest") - F.col("__below"))
    threshold = F.col("__prefix") + F.when(over & (F.col("__last") > 0), 1).otherwise(0)
    return state.select("__key", "source_size", "target", "__passes", threshold.cast("long").alias("__threshold"))


def _refine(sized: DataFrame, state: DataFrame, n_sources: int, low: int) -> DataFrame:
    """One level: histogram of the boundary bucket by its next bits, and the bucket in which the budget ends.

    ``__prefix``: the boundary bucket so far; ``__below``: words under it; ``__last``: words in it.
    """
    width = 1 << LEVEL_BITS
    code = F.shiftright(F.col("__hash"), low)
    rows = sized.select("__key", "__size", code.alias("__code"))
    ends = state.select("__key", "__prefix", "__below", "__rest")
    inside = rows.join(small(ends, n_sources), (rows["__key"] == ends["__key"])
                       & (F.shiftright(rows["__code"], LEVEL_BITS) == ends["__prefix"])).drop(ends["__key"])
    bars = inside.groupBy("__key", "__code").agg(F.sum("__size").alias("__words"))
    bars = bars.where("__words > 0")
    by_source = W.partitionBy("__key").orderBy("__code").rowsBetween(W.unboundedPreceding, 0)  # at most `width` rows
    summed = (bars.join(small(ends, n_sources), "__key")
              .withColumn("__upto", F.col("__below") + F.sum("__words").over(by_source)))
    first = (summed.where(F.col("__upto") > F.col("__rest")).groupBy("__key")
             .agg(F.min(F.struct("__code", (F.col("__upto") - F.col("__words")).alias("below"),
                                 F.col("__words").alias("last"))).alias("__end")))
    keep = state.drop("__last")
    return (keep.join(small(first, n_sources), "__key", "left")
            .withColumn("__last", F.coalesce(F.col("__end.last"), F.lit(0)))
            .withColumn("__below", F.coalesce(F.col("__end.below"), F.col("__below")))
            # no bar passes the budget: it ends where the bucket ends
            .withColumn("__prefix", F.coalesce(F.col("__end.__code"), F.col("__prefix") * width + F.lit(width)))
            .drop("__end"))
