"""SimHash near-duplicate detection.

Fingerprints: 64 bits over the XXH64 hashes of word shingles, computed in
Arrow batches.  Exact copies collapse to one row per fingerprint first.  Links
(at most ``max_bits`` differing bits) are found by the pigeonhole principle: the
64 bits are split into ``blocks`` parts, so that two close fingerprints agree
on at least ``blocks - max_bits`` of them; fingerprints are grouped on every
combination of that many parts (with 6 blocks and 3 bits, 20 keys of 31 to 33
bits, selective enough for billions of fingerprints), then verified by Hamming
distance.

A group of at most ``GROUP_ROWS`` fingerprints is verified in one row, and only
a spanning forest of its links is emitted, never all pairs.  Larger groups are
not collected: each member lists the patterns within two flips of the free bits
(and within one as anchor), and members meet on a shared pattern.  Two
fingerprints within 3 bits always share one, the smallest anchor of a pattern
stands for all of them, and no pattern gets more members than it has
neighbours.  Connected components then run over the distinct fingerprints.

Cases: a null, empty or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of all of them; rows that
repeat an id each get a row; null ids take part but never name a component
unless all its ids are null; very long texts are read whole; further columns are
left out by the query and kept by the stage, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstar.llm.common import cut, row_hash, small
from shopstar.llm.components import connected_components
from shopstar.operators.ranking import unused

SEED = 42
BITS = 64
DROP_ROWS = 500_000  # at most so many row hashes (8 bytes each) are broadcast
GROUP_ROWS = 256  # fingerprints of one key that are verified together in a row


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=max(1, len(words) - shingle + 1))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):
        part = np.unpackbits(h[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Add ``__fp`` (long); only the text goes to Python."""
    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([fingerprint(x, shingle) for x in t], dtype="int64")
    return docs.withColumn("__fp", simhash.asNondeterministic()(F.col(text_col)))


def block_bits(blocks: int) -> list[tuple[int, int]]:
    """(offset, width) of the parts, widths as even as possible."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Signed masks of all combinations of ``blocks - max_bits`` parts."""
    masks = []
    for chosen in combinations(block_bits(blocks), blocks - max_bits):
        m = sum(((1 << n) - 1) << at for at, n in chosen)
        masks.append(m - (1 << BITS) if m >= 1 << (BITS - 1) else m)
    return masks


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning links (i, j) of fingerprints within ``max_bits``; at most one less than there are."""
    n, left, links = len(fps), np.ones(len(fps), bool), []
    u = fps.view(np.uint64)
    for start in range(n):
        if not left[start]:
            continue
        left[start], reach = False, [start]
        while reach:
            i = reach.pop()
            near = np.flatnonzero(left & (np.bitwise_count(u ^ u[i]) <= max_bits))
            left[near] = False
            links.extend((i, int(j)) for j in near)
            reach.extend(near.tolist())
    return links


def links(distinct: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """(a, b): links whose transitive closure holds every pair of fingerprints within ``max_bits``."""
    masks = block_masks(blocks, max_bits)
    table = F.array(*[F.lit(m).cast("long") for m in masks])
    keyed = distinct.select(F.col("__fp").alias("fp"), F.posexplode(table).alias("combo", "mask"))
    keyed = keyed.select("combo", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    counts = keyed.groupBy("combo", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(counts, ["combo", "part"]))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def verify(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            fps = np.sort(np.asarray(g, dtype=np.int64))
            out.append([(int(fps[i]), int(fps[j])) for i, j in forest(fps, max_bits)])
        return pd.Series(out)

    grouped = shared.where(F.col("n") <= GROUP_ROWS).groupBy("combo", "part").agg(F.collect_list("fp").alias("g"))
    near = grouped.select(F.explode(verify("g")).alias("l")).select("l.a", "l.b")
    return near.unionByName(_dense_links(shared.where(F.col("n") > GROUP_ROWS), masks, max_bits))


def _dense_links(rows: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """Links inside groups too large for one row: members meet on patterns of the free bits.

    One end lists the patterns within ``max_bits // 2`` flips, the other those within the rest; all members of a
    pattern are linked to its smallest anchor (they are within ``max_bits`` of it).
    """
    inner, outer = max_bits // 2, max_bits - max_bits // 2
    free = [[b for b in range(BITS) if not m >> b & 1] for m in masks]

    def flips(n: int):
        tables = []
        for bits in free:
            one = np.array([1 << b for b in bits], dtype=np.uint64)
            sets = [np.zeros(1, np.uint64)]
            for size in range(1, n + 1):
                if size <= len(bits):
                    sets.append(np.bitwise_xor.reduce(one[np.array(list(combinations(range(len(bits)), size)))], axis=1))
            tables.append(np.concatenate(sets).view(np.int64))

        def spread(batches):
            for pdf in batches:
                for at in range(0, len(pdf), 64):
                    some = pdf.iloc[at:at + 64]
                    each = [fp ^ tables[c] for c, fp in zip(some["combo"], some["fp"].to_numpy(np.int64))]
                    lens = [len(e) for e in each]
                    yield pd.DataFrame({"combo": np.repeat(some["combo"].to_numpy(np.int32), lens),
                                        "pattern": np.concatenate(each), "fp": np.repeat(some["fp"].to_numpy(np.int64), lens)})
        return spread

    schema = "combo int, pattern long, fp long"
    cols = rows.select("combo", "fp")
    anchors = cols.mapInPandas(flips(inner), schema).groupBy("combo", "pattern").agg(F.min("fp").alias("a"))
    met = cols.mapInPandas(flips(outer), schema).join(anchors, ["combo", "pattern"])
    return met.select("a", F.col("fp").alias("b")).where("a <> b").distinct()


def _roots(prints: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """(__fp, __root): the component of every distinct fingerprint."""
    if not 0 <= max_bits < blocks:
        raise ValueError("blocks must be more than max_bits")
    distinct = cut(prints.select("__fp").distinct())
    roots = connected_components(links(distinct, blocks, max_bits), "a", "b").withColumnRenamed("node", "__fp")
    return distinct.join(roots, "__fp", "left").select("__fp", F.coalesce("root", "__fp").alias("__root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3,
               blocks: int = 6) -> DataFrame:
    """(id, fingerprint, component_id): one row a document; the component's name is its smallest id."""
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", shingle)
                 .select("__id", "__fp"))
    first = prints.groupBy("__fp").agg(F.min("__id").alias("__first"))
    named = cut(first.join(_roots(prints, blocks, max_bits), "__fp"))
    least = named.groupBy("__root").agg(F.min("__first").alias("component_id"))
    by_print = named.select("__fp", "__root").join(least, "__root").select("__fp", "component_id")
    return (prints.join(by_print, "__fp")
            .select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3,
             blocks: int = 6) -> DataFrame:
    """``docs`` without all but one row of each component.

    The row with the smallest id stays (null ids last; of an id's rows the one with the smallest hash); of rows equal
    in every column one stays.
    """
    row = row_hash(docs)
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("__id"), row.alias("__row"), F.col(text_col).alias("__text")),
                              "__text", shingle).select("__id", "__row", "__fp"))
    roots = cut(_roots(prints, blocks, max_bits))
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    by_print = prints.groupBy("__fp").agg(F.min(order).alias("__first")).join(roots, "__fp")
    stays = by_print.groupBy("__root").agg(F.min("__first").alias("__best")).select(F.col("__best.row").alias("__row"), F.lit(True).alias("__stays"))
    # rows to drop are few beside the corpus: they are counted, and broadcast only if they are
    goes = cut(prints.select("__row").distinct().join(stays.distinct(), "__row", "left").where("__stays is null").select("__row"))
    name, = unused(docs, "__row")
    goes = goes.withColumnRenamed("__row", name)
    kept = docs.withColumn(name, row).join(small(goes, goes.count(), DROP_ROWS), name, "left_anti").drop(name)
    total = prints.count()
    equal = prints.select("__row").distinct().count()
    return kept if total == equal else kept.dropDuplicates()
