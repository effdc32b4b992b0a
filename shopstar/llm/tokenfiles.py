"""Token ids in raw shard files, with keyed access through a minimal perfect hash index.

Files: every document's ids (little endian, 2 bytes an id for vocabularies up to 65,536, else 4) and the end id, in
ascending key order.  A shard file is the raw ids of its documents, a table of five big-endian 64-bit numbers per
document (key, offset, ids with the end id, place among equal keys, number of equal keys in the shard), a trailer of
eight 20-digit decimal numbers and a closing mark.  Spark's text sink writes it (one record a file), so the output
commit protocol covers retried tasks and lost executors, on any file system that Spark writes to.

Index: keys (document id and place among rows with that id) are dealt by hash into buckets of about ``BUCKET_KEYS``.
A bucket's minimal perfect hash is a cascade of bit arrays: a key takes the first level on which no other key of the
level falls on its bit; its slot is the number of bits set before it.  The slot holds a 32-bit fingerprint, shard,
offset, length, start and number of rows with that id.  A lookup touches one bucket and on average fewer than two
levels; a foreign key is refused by the bits or the fingerprint (one in 2^32 passes).

Encoding: the ``tokenizers`` library's model on the pieces that the tokenizer's own split pattern gives.  Texts within
Latin scripts are split here by an equal pattern and every distinct piece is encoded once per Python worker (a cache of
``CACHE_PIECES``); a text with any other character, and any tokenizer with another split, goes through the library whole.

Scale: one shuffle of the texts, by ranges of the key (a repeated key is spread by its text and a row number); shards
are cut at ``SHARD_IDS`` ids or ``SHARD_DOCS`` documents, whatever the ranges hold.  Nothing but the tokenizer's
definition (1.5 MB) is broadcast, and only counts reach the driver.

Cases: a null or empty text is its end id alone; a null key is a key like any other and comes first; rows with one key
are ordered by text hash and all kept; very long texts are encoded whole; an empty table gives no shard and an empty
index; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopstar.llm.common import cut

SHARD_IDS = 8_000_000
SHARD_DOCS = 200_000
BUCKET_KEYS = 16_384
CACHE_PIECES = 1_000_000
# Bits per key on a level: more bits, fewer levels.
GAMMA = 2.0
MARK = "\nTOKENIDS\n"
FIELDS = ("partition", "piece", "width", "n_ids", "n_docs", "n_null", "first_run", "last_run")
DIGITS, ENTRY = 20, 40

# The byte-level split pattern, written for Latin scripts and common punctuation.
_S, _L, _N = "\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
FOREIGN = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(rest)}


def _splits_by_pattern(spec: str) -> bool:
    d = json.loads(spec)
    split = d.get("pre_tokenizer") or {}
    return (d.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and d["model"].get("type") == "BPE" and not d["model"].get("dropout"))


def id_width(spec: str) -> int:
    """Bytes an id takes: 2 if all ids are below 65,536."""
    d = json.loads(spec)
    top = max([*d["model"]["vocab"].values(), *[t["id"] for t in d.get("added_tokens", [])]])
    return 2 if top < 1 << 16 else 4


def _worker_encoder(spec: str, width: int) -> Callable[[str], bytes]:
    """The encoder that this Python worker keeps from task to task, with its pieces."""
    kept = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__
    name = f"{zlib.crc32(spec.encode())}-{len(spec)}-{width}"
    if name not in kept:
        kept[name] = encoder(spec, width)
    return kept[name]


def encoder(spec: str, width: int) -> Callable[[str], bytes]:
    """A function from a text to its packed ids; strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    model, letters, code = tokenizer.model, _byte_letters(), "H" if width == 2 else "I"

    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{code}", *ids)

    class Pieces(dict):
        """The packed ids of every piece met so far."""

        def __missing__(self, piece: str) -> bytes:
            out = self[piece] = pack([t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))])
            return out

    pieces = Pieces()

    def whole(text: str) -> bytes:
        return pack(tokenizer.encode(text, add_special_tokens=False).ids)

    def by_pieces(text: str) -> bytes:
        if FOREIGN.search(text):
            return whole(text)
        if len(pieces) > CACHE_PIECES:
            pieces.clear()
        return b"".join(map(pieces.__getitem__, PIECES.findall(text)))

    return by_pieces if _splits_by_pattern(spec) else whole


def _shard(part: int, piece: int, width: int, keys: list, parts: list[bytes]) -> bytes:
    """The bytes of one shard file."""
    null = np.array([k is None for k in keys])
    key = np.array([k or 0 for k in keys], np.int64)
    n = np.array([len(p) // width for p in parts], np.int64)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(keys)))
    run = np.repeat(runs, runs)
    table = np.stack([key, np.cumsum(n) - n, n, np.arange(len(keys)) - np.repeat(first, runs), run], axis=1)
    numbers = (part, piece, width, n.sum(), len(keys), null.sum(), runs[0], runs[-1])
    return b"".join([*parts, table.astype(">i8").tobytes(), "".join(f"{int(x):0{DIGITS}}" for x in numbers).encode()])


def _shards(spec, end_id: int, width: int, shard_ids: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, held = TaskContext.get().partitionId(), 0, 0
        encode, end = _worker_encoder(spec.value, width), end_id.to_bytes(width, "little")
        keys, parts = [], []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_shard(part, piece, width, keys, parts)], pa.binary())], ["shard"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // width
                if keys and (held + n > shard_ids or len(keys) >= shard_docs):
                    yield full()
                    piece, held, keys, parts = piece + 1, 0, [], []
                keys.append(key)
                parts.append(ids)
                held += n
        if keys:
            yield full()
    return run


@dataclass(frozen=True)
class TokenFiles:
    """Written shards (``ids``), their tables (``tables``) and the index (``index``) below one folder."""

    spark: SparkSession
    path: str
    buckets: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
          shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> TokenFiles:
    """Encode the texts with the tokenizer file, write shards in key order and index them."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:  # the driver's copy; tasks get it by broadcast
        definition = f.read()
    width = id_width(definition)
    spec = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"),
                       F.monotonically_increasing_id().alias("r"))
    rows = rows.repartitionByRange("k", "h", "r").sortWithinPartitions("k", "h", "r").select("k", "t")
    made = rows.mapInArrow(_shards(spec, end_id, width, shard_ids, shard_docs), "shard binary")
    (made.select(F.col("shard").cast("string").alias("value")).write.option("lineSep", MARK).option("maxRecordsPerFile", "1")
     .option("compression", "none").text(f"{path}/ids"))
    return _index(spark, path)


def _number(raw: Column, place: Column) -> Column:
    """The big-endian signed number at a byte place (from 0)."""
    return F.conv(F.hex(raw.substr(place + 1, F.lit(8))), 16, -10).cast("bigint")


def _open(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard file: trailer fields, ``shard`` (ascending in key order), its raw ``ids`` and ``table``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    size = DIGITS * len(FIELDS)
    trailer = F.col("content").substr((F.col("length") - len(MARK) - size + 1).cast("int"), F.lit(size)).cast("string")
    fields = files.withColumn("trailer", trailer).select(
        "path", "content", *[F.substring("trailer", 1 + DIGITS * i, DIGITS).cast("bigint").alias(f) for i, f in enumerate(FIELDS)])
    place = (F.col("n_ids") * F.col("width") + 1).cast("int")
    return fields.withColumn("shard", F.col("partition") * (1 << 24) + F.col("piece")).withColumn(
        "table", F.col("content").substr(place, (F.col("n_docs") * ENTRY).cast("int")))


def _directory(tables: DataFrame) -> DataFrame:
    """Per shard: ids in all shards before, and what other shards hold of its first and last key."""
    by_part = tables.groupBy("partition").agg(F.sum("n_ids").alias("n"))  # one row a task of the writer
    before = F.coalesce(F.sum("n").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select("partition", before.alias("before"))
    inside = Window.partitionBy("partition").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = tables.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(by_part, "partition").select(
        "shard", (F.col("before") + F.col("inside")).alias("base"))
    edges = tables.select("shard", F.lit(0).alias("e"), F.col("first_key").alias("k"), F.col("first_run").alias("n")).unionByName(
        tables.where("first_run < n_docs").select("shard", F.lit(1).alias("e"), F.col("last_key").alias("k"), F.col("last_run").alias("n")))
    same = Window.partitionBy("k")  # the shards that begin or end with one key
    earlier = F.coalesce(F.sum("n").over(same.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select("shard", "e", earlier.alias("earlier"), F.sum("n").over(same).alias("all"))
    edges = edges.groupBy("shard").agg(F.max(F.when(F.col("e") == 0, F.col("earlier"))).alias("earlier"),
                                       F.max(F.when(F.col("e") == 0, F.col("all"))).alias("all_first"),
                                       F.max(F.when(F.col("e") == 1, F.col("all"))).alias("all_last"))
    return base.join(edges, "shard")


def _hashes(key: Column, ordinal: Column) -> list[Column]:
    parts = [key.isNull(), key.cast("bigint"), ordinal.cast("bigint")]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")]


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key on a level."""
    x = h1 ^ (h2 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level and the slot (0 to n-1, each once) of every key; the keys' hash pairs must differ."""
    levels, slots, left, base = [], np.empty(len(h1), np.int64), np.arange(len(h1)), 0
    while len(left):
        if len(levels) > 200:
            raise ValueError("two keys with the same 128 bits of hash")
        size = max(64, int(GAMMA * len(left)))
        place = _places(h1[left], h2[left], len(levels), size)
        bits = np.bincount(place, minlength=size) == 1
        alone = bits[place]
        slots[left[alone]] = base + np.cumsum(bits)[place[alone]] - 1
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slots


def slots_of(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The slots of any keys; -1 where no level has the key's bit."""
    out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, bits in enumerate(levels):
        place = _places(h1[left], h2[left], level, len(bits))
        hit = bits[place]
        out[left[hit]] = base + np.cumsum(bits)[place[hit]] - 1
        base += int(bits.sum())
        left = left[~hit]
    return out


_SLOT = np.dtype([("print", "<u4"), ("shard", "<i8"), ("offset", "<i8"), ("n", "<i8"), ("start", "<i8"), ("copies", "<i8")])


def _bucket_index(rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    levels, slot = perfect_hash(h1, h2)
    table = np.empty(len(rows), _SLOT)
    table["print"][slot] = h2 >> np.uint64(32)
    for c in _SLOT.names[1:]:
        table[c][slot] = rows[c].to_numpy()
    packed = [np.packbits(b).tobytes() for b in levels]
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "sizes": [[len(b) for b in levels]], "bits": [packed], "slots": [table.tobytes()]})


def _index(spark: SparkSession, path: str) -> TokenFiles:
    """Write the shards' tables and the index; the shards are read back for it."""
    opened = _open(spark, f"{path}/ids")
    first, last = _number(F.col("table"), F.lit(0)), _number(F.col("table"), ((F.col("n_docs") - 1) * ENTRY).cast("int"))
    opened.select("path", "shard", *FIELDS, "table", F.when(F.col("n_null") == 0, first).alias("first_key"),
                  F.when(F.col("n_null") < F.col("n_docs"), last).alias("last_key")).write.parquet(f"{path}/tables")
    tables = spark.read.parquet(f"{path}/tables")
    n = tables.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_KEYS))
    known = tables.join(_directory(tables.drop("table")), "shard")
    i = F.col("i")
    at = lambda j: _number(F.col("table"), (i * ENTRY + 8 * j).cast("int"))
    rows = known.select("*", F.explode(F.sequence(F.lit(0), (F.col("n_docs") - 1).cast("int"))).alias("i"))
    rows = rows.select("shard", "first_key", "last_key", "base", "earlier", "all_first", "all_last", F.when(i >= F.col("n_null"), at(0)).alias("key"),
                       at(1).alias("offset"), at(2).alias("n"), at(3).alias("place"), at(4).alias("run"))
    is_first, is_last = (F.col("key").eqNullSafe(F.col(c)) for c in ("first_key", "last_key"))
    ordinal = F.col("place") + F.when(is_first, F.col("earlier")).otherwise(0)
    copies = F.when(is_first, F.col("all_first")).when(is_last, F.col("all_last")).otherwise(F.col("run"))
    entries = rows.select(*_hashes(F.col("key"), ordinal), "shard", "offset", "n", (F.col("base") + F.col("offset")).alias("start"),
                          copies.alias("copies")).withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    entries.groupBy("bucket").applyInPandas(_bucket_index, "bucket long, sizes array<int>, bits array<binary>, slots binary").write.parquet(f"{path}/index")
    return TokenFiles(spark, path, buckets)


def _find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    names = ["key", "nokey", "ordinal", "shard", "offset", "n_tokens", "start", "copies"]
    if not len(asked) or not len(index):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
    one = index.iloc[0]
    levels = [np.unpackbits(np.frombuffer(b, np.uint8))[:size].astype(bool) for b, size in zip(one["bits"], one["sizes"], strict=True)]
    table = np.frombuffer(one["slots"], _SLOT)
    h1, h2 = (asked[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    slot = slots_of(levels, h1, h2)
    ok = slot >= 0
    ok[ok] = table["print"][slot[ok]] == h2[ok] >> np.uint64(32)
    hit, kept = table[slot[ok]], asked[ok]
    return pd.DataFrame({"key": kept["key"].to_numpy(), "nokey": kept["nokey"].to_numpy(), "ordinal": kept["ordinal"].to_numpy(), "shard": hit["shard"], "offset": hit["offset"],
                         "n_tokens": hit["n"], "start": hit["start"], "copies": hit["copies"]})


def locate(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """Where the rows of ``keys`` (key, ordinal; distinct) are: shard, offset, n_tokens, start and copies; none if not there."""
    asked = keys.select(F.col("key").cast("bigint").alias("key"), F.col("ordinal").cast("bigint").alias("ordinal"))
    asked = asked.select(F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNull().cast("long").alias("nokey"), "ordinal",
                         *_hashes(F.col("key"), F.col("ordinal"))).withColumn("bucket", F.pmod("h1", F.lit(files.buckets)))
    index = files.table("index").join(asked.select("bucket").distinct(), "bucket", "left_semi")
    found = asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        _find, "key long, nokey long, ordinal long, shard long, offset long, n_tokens long, start long, copies long")
    return found.withColumn("key", F.when(F.col("nokey") == 0, F.col("key"))).drop("nokey")


def locate_all(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """``locate`` for every row that has one of the distinct ``keys`` (key), repeated ids included."""
    first = cut(locate(files, keys.select("key", F.lit(0).alias("ordinal"))))
    more = first.where("copies > 1").select("key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies") - 1)).alias("ordinal"))
    return first.unionByName(locate(files, more))


def scan(files: TokenFiles, shards: list[str] | None = None) -> DataFrame:
    """The raw ids of every document, read from the shard files (or some of them): shard, offset, n_tokens, width, ids."""
    opened = _open(files.spark, shards or f"{files.path}/ids")

    def documents(s: Column) -> Column:
        place = lambda i, j: _number(s["table"], (i * ENTRY + 8 * j).cast("int"))
        cut_out = lambda d: s["content"].substr((d["offset"] * s["width"] + 1).cast("int"), (d["n_tokens"] * s["width"]).cast("int"))
        numbers = F.transform(F.sequence(F.lit(0), (s["n_docs"] - 1).cast("int")), lambda i: F.struct(
            place(i, 1).alias("offset"), place(i, 2).alias("n_tokens")))
        return F.transform(numbers, lambda d: F.struct(d["offset"], d["n_tokens"], cut_out(d).alias("ids")))

    # a lambda's argument is computed once a shard; a column would be computed anew for every document
    once = F.transform(F.array(F.struct("content", "table", "width", "n_docs")), documents)
    return opened.select("shard", "width", F.explode(F.flatten(once)).alias("d")).select("shard", "width", "d.*")


def fetch(files: TokenFiles, keys: list[int | None]) -> DataFrame:
    """The documents with these keys (a short list): key, ordinal, n_tokens, width, ids; reads their buckets and shards only."""
    asked = files.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key long")
    found = locate_all(files, asked)
    paths = found.select("shard").distinct().join(files.table("tables").select("shard", "path"), "shard").select("path")
    names = [r[0] for r in paths.collect()]  # at most one shard a key and copy
    if not names:
        return scan(files).join(found, ["shard", "offset", "n_tokens"]).select("key", "ordinal", "n_tokens", "width", "ids").where("false")
    return scan(files, names).join(found, ["shard", "offset", "n_tokens"]).select("key", "ordinal", "n_tokens", "width", "ids")


def ids_crc32(ids: Column, width: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    @F.pandas_udf("long")
    def crc(raw: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(r if b == 4 else np.frombuffer(r, "<u2").astype("<u4").tobytes()) for r, b in zip(raw, w, strict=True)], dtype="int64")
    return crc(ids, width)


def unpack(raw: bytes, width: int) -> np.ndarray:
    """Packed ids as numbers."""
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.int64)
