"""Toxicity: a counterfactually regularised linear classifier.

Features are the distinct lower-case words of a text and the four-letter stems
of longer words.  Training minimises, over a bounded sample of labelled
documents, the logistic loss plus an L1 and a small L2 penalty plus the mean
squared change of the score when identity terms are swapped: every sampled
document that names a group is paired with copies that name another group of the same
kind.  A group's name that merely co-occurs with toxic labels therefore
cannot carry weight, so neutral mentions are not flagged.

The sample is bounded (``per_label`` ids of each label); scoring reads whole
texts of all rows in Arrow batches, with the weights of at most
``max_features`` features sent along.

Cases: a null, empty or wordless text scores by the intercept alone; without labelled rows
every score is 0, with one label only it is that label; rows that repeat an id
are scored each, one of them is learnt from; words of over 40 letters are no
features; very long texts are read whole; features that separate the labels
equally well are taken in order of their letters; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstar.llm.common import cut, labelled_sample, one_per_id, small

PER_LABEL = 3000  # labelled documents of each label that are used to fit
MAX_FEATURES = 1024
MIN_DOCS = 4  # sampled documents that must hold a feature
STEM = 4
MAX_WORD = 40
L1, L2, FAIR = 4e-4, 1e-5, 4.0
ROUNDS = 300

WORD = re.compile(r"[^\W\d_]+")

# Identity terms by language and kind; a term is swapped for the next one of its kind.
IDENTITY = {
    "en": (
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
        ("black", "white", "asian", "latino", "indigenous"),
        ("african", "european", "american", "mexican", "chinese", "indian", "arab", "turkish", "polish", "russian"),
        ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
        ("man", "woman"), ("men", "women"), ("boy", "girl"), ("male", "female"), ("he", "she"), ("his", "her"),
        ("immigrant", "citizen", "refugee", "foreigner"), ("immigrants", "citizens", "refugees", "foreigners"),
        ("blind", "deaf", "disabled", "autistic"), ("old", "young"), ("elderly", "teenage")),
    "de": (
        ("muslime", "christen", "juden", "hindus", "buddhisten"), ("schwarze", "weiße"), ("frau", "mann"),
        ("schwul", "lesbisch", "hetero"), ("ausländer", "inländer"), ("türkisch", "polnisch", "russisch", "deutsch")),
    "fr": (("musulman", "chrétien", "juif", "hindou", "bouddhiste"), ("noir", "blanc"), ("femme", "homme"), ("immigré", "citoyen")),
    "es": (("musulmán", "cristiano", "judío", "hindú", "budista"), ("negro", "blanco"), ("mujer", "hombre"), ("inmigrante", "ciudadano")),
}
# Common words that tell in which language a text names a term that stands in several of them.
COMMON = {"en": {"the", "and", "of", "to", "is"}, "de": {"der", "die", "und", "das", "ist"},
          "fr": {"le", "la", "et", "les", "des"}, "es": {"el", "la", "y", "los", "de"}}


def swaps(language: str) -> list[dict[str, str]]:
    """Two replacements of every term of a language: the next and the last of its kind (one where there are two terms)."""
    return [{t: kind[(i + step) % len(kind)] for kind in IDENTITY[language] for i, t in enumerate(kind)} for step in (1, -1)]


SWAPS = {language: swaps(language) for language in IDENTITY}


def features(words: set[str]) -> set[str]:
    """Words, and stems marked by a star."""
    short = {w for w in words if len(w) <= MAX_WORD}
    return short | {w[:STEM] + "*" for w in words if len(w) > STEM}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped(words: set[str]) -> list[set[str]]:
    """Copies of a text's words with the identity terms replaced; none without such a term.

    A term of several languages is replaced as in the one whose common words and terms the text has most of (of equals
    the first).
    """
    likely = sorted(SWAPS, key=lambda lang: -len(words & (COMMON[lang] | SWAPS[lang][0].keys())))
    out = []
    for step in (0, 1):
        table = {t: new for lang in reversed(likely) for t, new in SWAPS[lang][step].items()}
        if hit := words & table.keys():
            new = (words - hit) | {table[w] for w in hit}
            if new not in out:
                out.append(new)
    return out


def training_features(sample: DataFrame, text_col: str) -> DataFrame:
    """(order, label, feats, swaps): features of each sampled document and of its identity swaps."""
    def extract(batches):
        for pdf in batches:
            rows = [(h, int(y), sorted(features(w)), [sorted(features(s)) for s in swapped(w)])
                    for h, y, w in zip(pdf["order"], pdf["__label"], map(words_of, pdf[text_col]))]
            yield pd.DataFrame(rows, columns=["order", "label", "feats", "swaps"])
    return (sample.select(F.xxhash64("__id", text_col).alias("order"), "__label", text_col)
            .mapInPandas(extract, "order long, label int, feats array<string>, swaps array<array<string>>"))


def select_features(rows: DataFrame, max_features: int) -> list[str]:
    """The features of the sample that separate the labels best (chi-square), at most ``max_features``."""
    totals = rows.groupBy("label").count().collect()  # at most two rows
    n = {r["label"]: float(r["count"]) for r in totals}
    n1, n0 = n.get(1, 0.0), n.get(0, 0.0)
    held = rows.select("label", F.explode("feats").alias("f")).groupBy("f").agg(
        F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    wide = (a + b) * (c + d)
    chi = F.when(wide > 0, F.pow(a * d - b * c, 2) / wide).otherwise(0.0)
    best = held.where(a + b >= MIN_DOCS).withColumn("chi", chi).orderBy(F.desc("chi"), "f").limit(max_features)
    return sorted(r["f"] for r in best.collect())


def pair_products(at: list, swaps: list, m: int) -> tuple[np.ndarray, int]:
    """(sum over all swapped pairs of the outer product of their feature differences, number of pairs)."""
    product, pairs = np.zeros((m, m), np.float64), 0
    for start in range(0, len(at), 500):  # at most 1,000 pairs at a time
        change = []
        for own, others in zip(at[start:start + 500], swaps[start:start + 500]):
            for o in others:
                d = np.zeros(m, np.float32)
                d[np.asarray(own, int)] = 1
                d[np.asarray(o, int)] -= 1
                change.append(d)
        if change:
            c = np.array(change)
            product += c.T @ c  # whole numbers, exact in any order
            pairs += len(c)
    return product, pairs


def fit_weights(x: np.ndarray, y: np.ndarray, product: np.ndarray, pairs: int, l1: float = L1, l2: float = L2, fair: float = FAIR,
                rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Accelerated proximal descent; ``product`` and ``pairs``: see ``pair_products``."""
    x, product = x.astype(np.float32), product.astype(np.float32)
    m = x.shape[1]
    # both labels weigh the same
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)

    def penalty(v: np.ndarray) -> np.ndarray | float:
        return np.float32(2 * fair / pairs) * (product @ v) if pairs else 0.0

    def curvature() -> float:
        v = np.full(m + 1, 1 / np.sqrt(m + 1), np.float32)
        size = 1.0
        for _ in range(20):
            e = 0.25 * share * (x @ v[:m] + v[m])
            g = np.append(x.T @ e + penalty(v[:m]), e.sum()).astype(np.float32)
            size = float(np.linalg.norm(g)) or 1.0
            v = g / size
        return 1.1 * size + l2

    step = np.float32(1.0 / curvature())
    w, pw, b, pb, t = np.zeros(m, np.float32), np.zeros(m, np.float32), 0.0, 0.0, 1.0
    for _ in range(rounds):
        e = share * (1.0 / (1.0 + np.exp(-np.clip(x @ pw + np.float32(pb), -30, 30))) - y.astype(np.float32))
        nw = pw - step * (x.T @ e + np.float32(l2) * pw + penalty(pw))
        nw = (np.sign(nw) * np.maximum(np.abs(nw) - step * np.float32(l1), 0)).astype(np.float32)
        nb = pb - float(step * e.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = (nw + np.float32((t - 1) / nt) * (nw - w)).astype(np.float32), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_label: int = PER_LABEL, max_features: int = MAX_FEATURES, fair: float = FAIR) -> dict:
    """A model: ``weights`` by feature and ``intercept``.  ``train`` is a condition on the labelled id column ``__id``."""
    ids = labelled_sample(labels, id_col, label_col, train, per_label)
    ids = cut(ids)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sample = one_per_id(texts.join(small(ids, 2 * per_label), "__id"), "__label")
    rows = cut(training_features(sample, "__text"))
    names = select_features(rows, max_features)
    place = {f: i for i, f in enumerate(names)}

    def to_index(batches):
        for pdf in batches:
            find = lambda fs: [place[f] for f in fs if f in place]
            yield pd.DataFrame({"order": pdf["order"], "label": pdf["label"], "at": [find(fs) for fs in pdf["feats"]],
                                "swaps": [[find(fs) for fs in s] for s in pdf["swaps"]]})

    # at most 2 * per_label rows of at most max_features small numbers
    got = (rows.mapInPandas(to_index, "order long, label int, at array<int>, swaps array<array<int>>")
           .orderBy("order", "label").limit(2 * per_label).toPandas())
    y = got["label"].to_numpy(float)
    if not len(y):
        return {"weights": {}, "intercept": None, "rate": 0.0}
    if y.min() == y.max():
        return {"weights": {}, "intercept": None, "rate": float(y[0])}
    x = np.zeros((len(y), len(names)), np.float32)
    for i, at in enumerate(got["at"]):
        x[i, np.asarray(at, int)] = 1
    w, b = fit_weights(x, y, *pair_products(list(got["at"]), list(got["swaps"]), len(names)), fair=fair)
    return {"weights": {f: float(v) for f, v in zip(names, w) if v}, "intercept": float(b), "rate": None}


def score_text(text: str | None, weights: dict[str, float], stems: frozenset, known: frozenset, intercept: float) -> float:
    words = words_of(text)
    z = intercept + sum(weights[w] for w in sorted(words & known))
    if stems:
        z += sum(weights[s + "*"] for s in sorted({w[:STEM] for w in words if len(w) > STEM} & stems))
    return 1.0 / (1.0 + float(np.exp(-min(30.0, max(-30.0, z)))))


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``out``: 0 to 1, higher is likelier toxic."""
    weights, rate, intercept = model["weights"], model["rate"], model["intercept"]
    if rate is not None:
        return docs.withColumn(out, F.lit(float(rate)))
    stems = frozenset(f[:-1] for f in weights if f.endswith("*"))
    known = frozenset(f for f in weights if not f.endswith("*"))

    @F.pandas_udf("double")
    def rate_texts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([score_text(x, weights, stems, known, intercept) for x in t], dtype="float64")
    return docs.withColumn(out, rate_texts.asNondeterministic()(F.col(text_col)))
