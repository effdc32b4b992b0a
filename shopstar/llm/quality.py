"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms of a text are its words (lower case, hashed to ``WORDS`` places), its
byte-class bigrams (letters by case, digits, blanks, every ASCII sign, bytes of
other scripts) and two terms of repetition: adjacent repeats and repeated words.
Square roots of relative frequencies, weighted by inverse
document frequency, are reduced by a truncated SVD that is fitted on a bounded
sample of labelled documents.  The labelled vectors are broadcast (``per_label``
of each label, ``rank`` numbers each); every document's vector meets all of
them in blocked matrix products, and its nearest ones vote with their
similarity, weighted so that the labels keep their true shares.

Cases: a null or empty text is like no other: it scores the share of label 1;
without labelled rows every score is 0, with one label only it is that label;
rows that repeat an id are scored each, one of them is learnt from; very long
texts are read whole; where equally near neighbours stand at the border, the
partial sort's choice counts, the same on every run; extra columns are kept.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstar.llm.common import cut, labelled_sample, one_per_id, small

PER_LABEL = 2000  # labelled documents of each label that are fitted and broadcast
RANK = 32
NEIGHBOURS = 15
SHARPNESS = 8  # a neighbour's vote is its cosine to this power
BLOCK = 256  # documents in a matrix product
THRESHOLD = 0.7


def byte_classes() -> np.ndarray:
    """256 -> class: lower, upper, digit, blank, newline, each other ASCII sign, other control, first and later UTF-8 bytes."""
    table = np.zeros(256, np.int64)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        if b in signs:
            table[b] = 8 + signs.index(b)
        elif b >= 128:
            table[b] = 6 if b >= 192 else 7
        else:
            table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c == "\n" else 5
    return table


CLASSES = byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
SHAPES = N_CLASSES * N_CLASSES
WORDS = 1024  # places of hashed words
WORD_SHARE = 0.25  # of all words against all bigrams
TERMS = SHAPES + 2 + WORDS


def term_vector(text: str | None) -> np.ndarray:
    """Square roots of the relative term frequencies; all zero for an empty text."""
    v = np.zeros(TERMS, np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < 2:
        return v
    c = CLASSES[data]
    v[:SHAPES] = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=SHAPES) / (len(data) - 1)
    words = text.split()
    if len(words) > 1:
        v[SHAPES] = sum(map(str.__eq__, words[1:], words)) / (len(words) - 1)
        v[SHAPES + 1] = (1 - len(set(words)) / len(words)) ** 4  # only heavy repetition counts
    counts = Counter(text.lower().split())
    places = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in counts), np.int64, len(counts))
    held = np.fromiter(counts.values(), np.float64, len(counts))
    v[SHAPES + 2:] = np.bincount(places, held, WORDS) * (WORD_SHARE / max(len(words), 1))
    return np.sqrt(v)


def packed(v: np.ndarray) -> tuple[bytes, bytes]:
    """A term vector as places and values of what is not zero."""
    at = np.flatnonzero(v).astype(np.int32)
    return at.tobytes(), v[at].tobytes()


def unpacked(at, values) -> np.ndarray:
    """The term vectors of packed ones, a row each."""
    x = np.zeros((len(at), TERMS), np.float32)
    for row, a, v in zip(x, at, values):
        row[np.frombuffer(a, np.int32)] = np.frombuffer(v, np.float32)
    return x


def fit_space(x: np.ndarray, rank: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis): weights of the terms and the leading right singular vectors, by subspace iteration."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = unit(x * idf)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(weighted.T @ (weighted @ q))
    _, _, v = np.linalg.svd(weighted @ q, full_matrices=False)
    return idf, np.ascontiguousarray((q @ v.T)[:, :rank], dtype=np.float32)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_label: int = PER_LABEL, rank: int = RANK) -> dict:
    """A model: the space, the labelled vectors and their votes.  ``train`` is a condition on the labelled id ``__id``."""
    ids = cut(labelled_sample(labels, id_col, label_col, train, per_label))
    counts = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("y")).where(train)
              .agg(F.count(F.when(F.col("y") == 0, 1)).alias("n0"), F.count(F.when(F.col("y") == 1, 1)).alias("n1")).first())
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sample = one_per_id(texts.join(small(ids, 2 * per_label), "__id"), "__label").select(F.xxhash64("__id", "__text").alias("order"), "__label", "__text")

    def extract(batches):
        for pdf in batches:
            rows = [packed(term_vector(t)) for t in pdf["__text"]]
            yield pd.DataFrame({"order": pdf["order"], "label": pdf["__label"].astype("int32"),
                                "at": [r[0] for r in rows], "v": [r[1] for r in rows]})

    # at most 2 * per_label rows of at most TERMS numbers
    got = sample.mapInPandas(extract, "order long, label int, at binary, v binary").orderBy("order", "label").limit(2 * per_label).toPandas()
    y = got["label"].to_numpy(np.float32)
    if not len(y):
        return {"rate": 0.0}
    if y.min() == y.max():
        return {"rate": float(y[0])}
    x = unpacked(got["at"], got["v"])
    idf, basis = fit_space(x, rank)
    vectors = unit((unit(x * idf)) @ basis)
    share = counts["n1"] / (counts["n0"] + counts["n1"])
    vote = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    return {"rate": None, "idf": idf, "basis": basis, "vectors": np.ascontiguousarray(vectors.T, np.float32), "y": y,
            "vote": vote, "share": float(share)}


def vote(x: np.ndarray, model: dict, neighbours: int) -> np.ndarray:
    """Scores of term vectors: similarity-weighted share of label 1 among the nearest labelled vectors."""
    latent = unit((unit(x * model["idf"])) @ model["basis"])
    out = np.full(len(x), model["share"])
    k = min(neighbours, len(model["y"]))
    for at in range(0, len(x), BLOCK):
        cosine = latent[at:at + BLOCK] @ model["vectors"]
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS * model["vote"][near]
        total = w.sum(axis=1)
        found = total > 1e-9
        out[at:at + BLOCK][found] = np.clip((w * model["y"][near]).sum(axis=1)[found] / total[found], 0, 1)
    return out


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "quality_score",
          neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with the column ``out``: 0 to 1, higher is likelier label 1."""
    if model["rate"] is not None:
        return docs.withColumn(out, F.lit(float(model["rate"])))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 * PER_LABEL * RANK floats and the basis: about 1 MB

    @F.pandas_udf("double")
    def rate_texts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for t in texts:
            scores = [vote(np.stack([term_vector(x) for x in t[at:at + BLOCK]]), m, neighbours) for at in range(0, len(t), BLOCK)]
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))
    return docs.withColumn(out, rate_texts.asNondeterministic()(F.col(text_col)))
