"""LM scoring by deleted interpolation of n-gram maximum-likelihood estimates.

    P(w | h) = sum over k of weight[k][bucket(h)] * c(h_k w) / c(h_k)   (+ a uniform share)

h_k are the last k tokens (h_0: none; up to ``order - 1``).  The bucket of a
context is the power of two of its training count.  The weights are learnt by
expectation-maximisation on held-out counts: one fold of the training documents
is held out, the estimates come from the others, and its tokens are summed in a
histogram of their (bucket, estimates) cells, which the driver iterates over.
Final estimates use the counts of all training documents.

Counts cover the whole corpus and are exact.  Texts are encoded once, in
blocks of some MB: distinct words with 64-bit hashes and the token sequence as
word numbers.  From every block each distinct n-gram goes once, with its counts,
to the hash bucket that sums it, and its corpus counts come back in the same
order; so a frequent word costs one entry a block, never a row a document, and no
task holds more than its bucket or its block.

Cases: a null text is empty; an empty text is the end token alone; rows that repeat an id are
scored each (and learnt from each); a null id is never learnt from and counts as held out; without
training documents all counts are 0 and the model is uniform; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstar.llm.common import cut, release

ORDER = 2
BLOCK_BYTES = 8 << 20  # text that a block holds, a longer document alone
MAX_BUCKET = 24  # contexts are bucketed by the power of two of their count, up to this one
CELLS = 8  # histogram cells a factor of e in an estimate
EM_ROUNDS = 60
END = 0  # word number of the end token in every block
END_HASH = np.uint64(0x9E3779B97F4A7C15)
TEST, TRAIN, HELD = 0, 1, 2  # parts of the corpus: not learnt from, estimates, held out for the weights

MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def pack(a: np.ndarray) -> bytes:
    """Bytes of an integer array, by byte plane and compressed (high planes are mostly zero)."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).ravel()


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, token numbers, tokens of each text); number 0 is the end token."""
    number: dict[bytes, int] = {}
    sizes, codes = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sizes.append(len(words) + 1)
        codes.extend([number.setdefault(w, len(number) + 1) for w in words])
        codes.append(END)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), dtype=np.uint64, count=len(number))
    return np.concatenate([[END_HASH], hashes]).astype(np.uint64), np.array(codes, np.int32), np.array(sizes, np.int64)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


class Grams:
    """The n-grams of one length in a block: each token's n-gram number, and the distinct n-grams sorted by hash."""

    def __init__(self, tokens: np.ndarray, valid: np.ndarray):
        self.valid = valid  # tokens that have enough context
        self.keys, inverse = np.unique(tokens[valid], return_inverse=True)
        self.number = np.full(len(tokens), -1, np.int64)
        self.number[valid] = inverse

    def counts(self, part: np.ndarray, which: int) -> np.ndarray:
        rows = self.valid & (part == which)
        return np.bincount(self.number[rows], minlength=len(self.keys)).astype(np.uint32)

    def spread(self, counts: np.ndarray) -> np.ndarray:
        """Counts of each token's n-gram; 0 where there is too little context."""
        out = np.zeros(len(self.number), np.int64)
        out[self.valid] = counts[self.number[self.valid]]
        return out


def block_grams(hashes: np.ndarray, codes: np.ndarray, sizes: np.ndarray, order: int) -> list[Grams]:
    """By length 1 to ``order``: n-grams within documents, ending at each token."""
    ends = np.cumsum(sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    with np.errstate(over="ignore"):
        first = hashes[codes]
        out, h = [Grams(scramble(first), np.ones(len(codes), bool))], scramble(first)
        for n in range(2, order + 1):
            before = np.zeros_like(first)
            before[n - 1:] = first[:len(first) - n + 1]
            h = scramble(h * np.uint64(3) + before + np.uint64(n))
            out.append(Grams(h, place >= n - 1))
    return out


def blocks(docs: DataFrame, order: int) -> DataFrame:
    """Encoded blocks: id, documents (``__id`` and ``__part``), word hashes, tokens, sizes.

    Held-out documents have blocks of their own, so learning the weights moves no others.
    """
    schema = "block long, held boolean, ids array<long>, part array<int>, hashes binary, codes binary, sizes array<long>"

    def make(rows: list) -> pd.DataFrame:
        hashes, codes, sizes = encode([r[2] for r in rows])
        return pd.DataFrame({"block": [uuid.uuid4().int >> 65], "held": [rows[0][1] == HELD], "ids": [[r[0] for r in rows]], "part": [[r[1] for r in rows]],
                             "hashes": [pack(hashes)], "codes": [pack(codes)], "sizes": [sizes.tolist()]})

    def gather(batches: Iterator[pd.DataFrame]):
        rows, size = {True: [], False: []}, {True: 0, False: 0}
        for pdf in batches:
            ids = [None if x is None or x != x else int(x) for x in pdf["__id"].astype(object)]
            for r in zip(ids, pdf["__part"].tolist(), pdf["__text"]):
                held = r[1] == HELD
                rows[held].append(r)
                size[held] += len(r[2] or "") + 16
                if size[held] >= BLOCK_BYTES:
                    yield make(rows[held])
                    rows[held], size[held] = [], 0
        for rest in rows.values():
            if rest:
                yield make(rest)
    return docs.select("__id", "__part", "__text").mapInPandas(gather, schema)


def opened(r, order: int) -> tuple[list[Grams], np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams by length, token sizes, part of each token, part of each document) of a block row."""
    sizes, part = np.asarray(r.sizes, np.int64), np.asarray(r.part, np.int64)
    grams = block_grams(unpack(r.hashes, np.uint64), unpack(r.codes, np.int32), sizes, order)
    return grams, sizes, np.repeat(part, sizes), part


def bucket_edges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the hash space begins in sorted keys (and the end)."""
    step = (1 << 64) // n
    return np.append(np.searchsorted(keys, np.array([i * step for i in range(n)], dtype=np.uint64)), len(keys))


def send_counts(enc: DataFrame, order: int, n: int) -> DataFrame:
    """(block, bucket, n-gram length, distinct keys, training and held-out counts), one row a block, length and bucket."""
    schema = "block long, bucket int, length int, keys binary, train binary, held binary"

    def send(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                grams, _, part, _ = opened(r, order)
                for length, g in enumerate(grams, 1):
                    train, held = g.counts(part, TRAIN), g.counts(part, HELD)
                    edges = bucket_edges(g.keys, n)
                    rows = []
                    for i, (a, b) in enumerate(zip(edges, edges[1:])):
                        if b > a:
                            step = np.diff(g.keys[a:b], prepend=np.uint64(0))
                            rows.append((r.block, i, length, pack(step), pack(train[a:b]), pack(held[a:b])))
                    yield pd.DataFrame(rows, columns=["block", "bucket", "length", "keys", "train", "held"])
    return enc.mapInPandas(send, schema)


def sum_counts(sent: DataFrame) -> DataFrame:
    """The corpus counts for each row sent, in its order, and per (bucket, length) the distinct training n-grams and tokens."""
    schema = "block long, bucket int, length int, train binary, held binary, kinds long, kinds_train long, tokens long, tokens_train long"

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in pdf["keys"]]
        kinds, number = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for c in ("train", "held"):
            each = np.concatenate([unpack(x, np.uint32) for x in pdf[c]])
            sums.append(np.bincount(number, weights=each, minlength=len(kinds)).astype(np.int64))
        ends = np.cumsum([len(k) for k in keys])
        back = [[pack(s[number[b - len(k):b]]) for k, b in zip(keys, ends)] for s in sums]
        both = sums[0] + sums[1]
        stats = ((both > 0).sum(), (sums[0] > 0).sum(), both.sum(), sums[0].sum())
        first = np.arange(len(pdf)) == 0  # stated once a group
        out = pd.DataFrame({"block": pdf["block"].to_numpy(), "bucket": key[0], "length": key[1], "train": back[0], "held": back[1]})
        for name, v in zip(("kinds", "kinds_train", "tokens", "tokens_train"), stats):
            out[name] = np.where(first, v, 0)
        return out
    return sent.groupBy("bucket", "length").applyInPandas(total, schema)


def contexts(counts: list[np.ndarray], sizes: np.ndarray, total: int) -> list[np.ndarray]:
    """c(h) of each token by context length: all tokens, then the n-gram counts one token earlier."""
    out = [np.full(len(counts[0]), total, np.int64)]
    for c in counts[:-1]:
        before = np.zeros_like(c)
        before[1:] = c[:-1]
        before[(np.cumsum(sizes) - sizes)] = 0
        out.append(before)
    return out


def estimates(counts: list[np.ndarray], sizes: np.ndarray, total: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the longest context's count, estimates [tokens, order + 1] with the uniform one first)."""
    ctx = contexts(counts, sizes, total)
    p = [np.full(len(counts[0]), 1.0 / (kinds + 1))]
    p += [np.where(h > 0, c / np.maximum(h, 1), 0.0) for c, h in zip(counts, ctx)]
    longest = ctx[-1]
    bucket = np.where(longest > 0, np.minimum(1 + np.log2(np.maximum(longest, 1)).astype(int), MAX_BUCKET), 0)
    return bucket, np.stack(p, axis=1)


def learn_weights(cells: pd.DataFrame, order: int) -> np.ndarray:
    """EM over histogram cells (bucket, cell of each estimate, tokens): weights [bucket, order + 1]."""
    w = np.full((MAX_BUCKET + 1, order + 1), 1.0 / (order + 1))
    w[0, 0], w[0, -1] = w[0, 0] + w[0, -1], 0.0  # no context: the longest estimate is void
    if not len(cells):
        return w
    bucket, n = cells["bucket"].to_numpy(int), cells["n"].to_numpy(float)
    p = np.stack([np.where(cells[f"c{k}"] > 0, np.exp(-(cells[f"c{k}"] - 1) / CELLS), 0.0) for k in range(order + 1)], axis=1)
    for _ in range(EM_ROUNDS):
        mass = w[bucket] * p
        mass *= (n / np.maximum(mass.sum(axis=1), 1e-300))[:, None]
        for k in range(order + 1):
            sums = np.bincount(bucket, weights=mass[:, k], minlength=MAX_BUCKET + 1)
            w[:, k] = sums + (1e-3 if k == 0 else 1e-6)  # the uniform share never vanishes
        w[0, 0], w[0, -1] = w[0, 0] + w[0, -1], 0.0
        w /= w.sum(axis=1, keepdims=True)
    return w


def score(docs: DataFrame, train: Column, held: Column, id_col: str = "doc_id", text_col: str = "text",
          order: int = ORDER) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), logs to base 10.

    ``train`` and ``held`` are conditions on ``__id``: documents to learn from, and those among them that are held out
    for the weights.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    part = F.when(~train, TEST).when(held, HELD).otherwise(TRAIN).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).withColumn("__part", part)
    enc = cut(blocks(rows, order))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    back = cut(sum_counts(send_counts(enc, order, n)))
    release(docs.sparkSession)  # the n-grams sent are the largest shuffle; the counts are kept
    stats = {r["length"]: r for r in back.groupBy("length").agg(
        F.sum("kinds").alias("kinds"), F.sum("kinds_train").alias("kinds_train"), F.sum("tokens").alias("tokens"),
        F.sum("tokens_train").alias("tokens_train")).collect()}  # one row an n-gram length
    if not stats:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    one = stats[1]

    def histogram(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                grams, sizes, token_part, doc_part = opened(r, order)
                rows = token_part == HELD
                counts = [g.spread(c) for g, c in zip(grams, _received(r, grams, "train"))]
                bucket, p = estimates(counts, sizes, one["tokens_train"], one["kinds_train"])
                cell = np.where(p > 0, 1 + np.round(-CELLS * np.log(np.maximum(p, 1e-300))).astype(int), 0)
                frame = pd.DataFrame({f"c{k}": cell[rows, k] for k in range(order + 1)} | {"bucket": bucket[rows]})
                yield frame.groupby(list(frame.columns)).size().rename("n").reset_index()

    names = [f"c{k}" for k in range(order + 1)]
    # cells: buckets times the cells of each estimate, whatever the size of the corpus
    cells = (_with_counts(enc.where("held"), back).mapInPandas(histogram, ", ".join(f"{c} int" for c in names) + ", bucket int, n long")
             .groupBy(*names, "bucket").agg(F.sum("n").alias("n")).toPandas())
    weights = learn_weights(cells.sort_values([*names, "bucket"]), order)

    def rate(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                grams, sizes, _, _ = opened(r, order)
                both = [a + b for a, b in zip(_received(r, grams, "train"), _received(r, grams, "held"))]
                counts = [g.spread(c) for g, c in zip(grams, both)]
                bucket, p = estimates(counts, sizes, one["tokens"], one["kinds"])
                start = np.cumsum(sizes) - sizes
                base = np.log10((counts[0] + 0.5) / (one["tokens"] + 0.5 * (one["kinds"] + 1)))
                mixed = np.log10((weights[bucket] * p).sum(axis=1))
                yield pd.DataFrame({id_col: pd.array([None if x is None or x != x else int(x) for x in r.ids], dtype="Int64"),
                                    "n_tokens": sizes, "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), start),
                                    "train_tokens": one["tokens"], "base_score": np.add.reduceat(base, start),
                                    "score": np.add.reduceat(mixed, start)})
    return _with_counts(enc, back).mapInPandas(rate, f"{id_col} long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _with_counts(enc: DataFrame, back: DataFrame) -> DataFrame:
    """Every block with the counts that came back for it (as many entries as it has n-grams)."""
    got = back.groupBy("block").agg(F.collect_list(F.struct("length", "bucket", "train", "held")).alias("got"))
    return enc.join(got, "block")


def _received(r, grams: list[Grams], which: str) -> list[np.ndarray]:
    out = []
    for length in range(1, len(grams) + 1):
        pieces = sorted((x["bucket"], x[which]) for x in r.got if x["length"] == length)
        out.append(np.concatenate([unpack(d, np.int64) for _, d in pieces]) if pieces else np.zeros(0, np.int64))
    return out
