"""Language identification with interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language, over the letters of lower-case words
with the blank as word boundary.  N-gram counts of a bounded sample of the
labelled documents (``docs_per_lang`` of each language) are summed by Spark; the
tables hold the interpolated log-probabilities and back-off weights of all
languages side by side, by n-gram length, as arrays sorted by hash, and are
searched by binary search.  A text gets the language with the lowest
cross-entropy per letter.  On further documents of the sample (``calibrate``)
two things are calibrated: the temperature that turns cross-entropies into the
score, and each language's usual cross-entropy, beyond which a text is rejected
(it reads like none of the languages learnt).

Cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; letters that no language has fall back to the models' floor; a table
without a usable language gives ``und`` throughout; rows that repeat an id are
judged each, one of them a language is learnt from; very long texts are read
whole; of languages with equal cross-entropy the first in order of their names
counts; extra columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstar.llm.common import cut, one_per_id

ORDER = 4
DOCS_PER_LANG = 800  # documents of a language that are counted, about
CALIBRATE = 200  # further documents of a language for the calibration, about
UNKNOWN = "und"
STEADY = 200  # letters at which a text's cross-entropy varies as usual; shorter ones vary more
REJECT_AT = 25.0  # deviations beyond the usual cross-entropy, at least: mixed languages and codes in a text stay below

WORD = re.compile(r"[^\W\d_]+")
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                        0xE7037ED1A0B428DB], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    words = WORD.findall((text or "").lower())
    if words and not "".join(words).isalpha():  # numerals that are no digits, such as superscripts
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


def events(word: str, order: int) -> Iterator[str]:
    """The longest n-gram that ends at each letter of the word and at the blank behind it."""
    s = f" {word} "
    for i in range(1, len(s)):
        yield s[max(0, i - order + 1):i + 1]


def gram_hash(gram: str) -> int:
    """Hash by the distance of each character from the end."""
    h = len(gram)
    for j, c in enumerate(reversed(gram)):
        h += ord(c) * int(MULTIPLIERS[j])
    return h & (2 ** 64 - 1)


class KneserNey:
    """Counts of one language: raw for the longest events, continuations below."""

    def __init__(self, raw: dict[str, int], order: int):
        self.order = order
        self.counts: list[dict[str, int]] = [Counter() for _ in range(order + 1)]
        for g, n in raw.items():
            self.counts[len(g)][g] += n
        for n in range(order - 1, 0, -1):  # distinct left neighbours of what does not start a word
            for g in self.counts[n + 1]:
                self.counts[n][g[1:]] += 1
        self.total: list[dict[str, int]] = [Counter() for _ in range(order + 1)]
        self.kinds: list[dict[str, int]] = [Counter() for _ in range(order + 1)]
        self.discount = [0.5] * (order + 1)
        for n in range(1, order + 1):
            once = sum(1 for v in self.counts[n].values() if v == 1)
            twice = sum(1 for v in self.counts[n].values() if v == 2)
            self.discount[n] = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            for g, v in self.counts[n].items():
                self.total[n][g[:-1]] += v
                self.kinds[n][g[:-1]] += 1
        self.floor = 1.0 / (len(self.counts[1]) + 1)
        self.seen: dict[str, float] = {}

    def backoff(self, context: str) -> float:
        n = len(context) + 1
        total = self.total[n].get(context, 0)
        return self.discount[n] * self.kinds[n][context] / total if total else 1.0

    def prob(self, gram: str) -> float:
        if gram in self.seen:
            return self.seen[gram]
        lower = self.prob(gram[1:]) if len(gram) > 1 else self.floor
        n = len(gram)
        total = self.total[n].get(gram[:-1], 0)
        p = lower
        if total:
            p = max(self.counts[n].get(gram, 0) - self.discount[n], 0) / total + self.backoff(gram[:-1]) * lower
        self.seen[gram] = p
        return p


def sorted_table(rows: dict[str, list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, float32 rows in that order)."""
    keys = np.array([gram_hash(g) for g in rows], dtype=np.uint64)
    values = np.array(list(rows.values()), dtype=np.float32).reshape(len(rows), -1)
    order = np.argsort(keys)
    return keys[order], values[order]


def build(raw: dict[str, dict[str, int]], order: int) -> dict:
    """Tables of all languages: per n-gram length the log-probabilities, and per context length the log back-off weights."""
    langs = sorted(raw)
    models = [KneserNey(raw[lang], order) for lang in langs]
    probs, backs = [], []
    for n in range(1, order + 1):
        grams = sorted(set().union(*[m.counts[n].keys() for m in models]))
        probs.append(sorted_table({g: [float(np.log(m.prob(g))) for m in models] for g in grams}))
        contexts = sorted({g[:-1] for g in grams}) if n > 1 else []
        backs.append(sorted_table({c: [float(np.log(m.backoff(c))) for m in models] for c in contexts}) if n > 1 else None)
    floor = np.log(np.array([m.backoff("") * m.floor for m in models], dtype=np.float64)).astype(np.float32)
    return {"langs": langs, "order": order, "probs": probs, "backs": backs, "floor": floor}


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of hashes in a sorted array."""
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][at] == keys, at


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Log-probability of each word (with the blank behind it) in every language."""
    text = " " + " ".join(words) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    order, where = model["order"], np.arange(len(cp))
    blank = cp == 32
    last = np.maximum.accumulate(np.where(blank, where, 0))
    reach = np.minimum(where[1:] - last[:-1], order - 1)  # letters of context, up to the blank before the word
    hashes = []  # by length: hash of the n-gram that ends at each place
    h = np.zeros(len(cp), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(order):
            shifted = np.zeros(len(cp), np.uint64)
            shifted[j:] = cp[:len(cp) - j] if j else cp
            h = h + shifted * MULTIPLIERS[j]
            hashes.append(h + np.uint64(j + 1))
    out = np.zeros((len(cp), len(model["langs"])), np.float32)
    pending = where[1:]
    length = reach + 1
    for n in range(order, 0, -1):
        take = pending[length[pending - 1] >= n]
        if not len(take):
            continue
        found, at = look_up(model["probs"][n - 1], hashes[n - 1][take])
        hit = take[found]
        out[hit] += model["probs"][n - 1][1][at[found]]
        missed = take[~found]
        if n > 1:
            known, spot = look_up(model["backs"][n - 1], hashes[n - 2][missed - 1])
            out[missed[known]] += model["backs"][n - 1][1][spot[known]]
        else:
            out[missed] += model["floor"]
        done = np.zeros(len(cp), bool)
        done[hit] = True
        pending = pending[~done[pending]]
    starts = np.flatnonzero(blank)[:-1] + 1
    return np.add.reduceat(out[1:], starts - 1, axis=0)


def entropies(texts, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per letter in every language, letters) of each text; nan without letters."""
    docs = [words_of(t) for t in texts]
    sizes = np.array([len(d) for d in docs])
    flat = [w for d in docs for w in d]
    out, letters = np.full((len(docs), len(model["langs"])), np.nan), np.zeros(len(docs), np.int64)
    if not flat:
        return out, letters
    codes, kinds = pd.factorize(np.array(flat, dtype=object))
    scores = word_scores(list(kinds), model).astype(np.float64)
    lens = np.array([len(w) + 1 for w in kinds])
    has = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[has]
    n = np.add.reduceat(lens[codes], starts)
    letters[has] = n
    for lang in range(scores.shape[1]):
        out[has, lang] = -np.add.reduceat(scores[:, lang][codes], starts) / n
    return out, letters


def posterior(h: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * (h - h.min(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def deviation(h: np.ndarray, letters: np.ndarray, usual: np.ndarray, spread: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return (h - usual[lang]) / (spread[lang] * np.sqrt(1 + STEADY / np.maximum(letters, 1)))


def calibrate(h: np.ndarray, letters: np.ndarray, truth: np.ndarray, n_langs: int) -> dict:
    """Temperature by likelihood; usual cross-entropy and its spread by language; the deviation at which to reject."""
    grid = [2.0 ** (i / 2) for i in range(0, 17)]
    rows = np.arange(len(h))
    likelihood = [np.log(np.maximum(posterior(h, t)[rows, truth], 1e-6)).mean() if len(h) else 0.0 for t in grid]
    best = h.argmin(axis=1) if len(h) else np.zeros(0, int)
    own = h[rows, best] if len(h) else np.zeros(0)
    usual, spread = np.full(n_langs, np.median(own) if len(own) else 3.0), np.full(n_langs, 0.25)
    for lang in range(n_langs):
        mine = own[(best == lang) & (truth == lang)]
        if len(mine) >= 20:
            usual[lang] = np.median(mine)
            spread[lang] = max(0.05, 1.4826 * np.median(np.abs(mine - usual[lang])))
    far = deviation(own, letters, usual, spread, best) if len(own) else np.zeros(0)
    right = far[best == truth] if len(own) else far
    limit = max(REJECT_AT, 1.5 * float(right.max()) if len(right) else 0.0)
    return {"temperature": grid[int(np.argmax(likelihood))], "usual": usual, "spread": spread, "limit": limit}


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG, calibrate_docs: int = CALIBRATE) -> dict | None:
    """A model from the documents where ``train`` (a condition on ``__id``) holds and the language is known.

    A language with many documents gives those with the smallest id hashes: about ``docs_per_lang`` to count and
    ``calibrate_docs`` to calibrate; the driver receives n-gram counts and cross-entropies, no text.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text")).where(
        train & F.col("__lang").isNotNull() & (F.col("__lang") != UNKNOWN))
    counts = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().collect()}  # one row a language
    if not counts:
        return None
    scale = 1 << 30
    whole = docs_per_lang + calibrate_docs
    parts = {lang: (int(scale * min(1.0, docs_per_lang / n)) if n > whole else scale * docs_per_lang // whole,
                    int(scale * min(1.0, whole / n))) for lang, n in counts.items()}
    first = F.create_map(*[F.lit(x) for lang, (a, _) in parts.items() for x in (lang, a)])
    upto = F.create_map(*[F.lit(x) for lang, (_, b) in parts.items() for x in (lang, b)])
    draw = F.pmod(F.xxhash64("__id"), F.lit(scale))
    sample = cut(one_per_id(rows.where(draw < F.element_at(upto, F.col("__lang"))), "__lang")
                 .withColumn("__count", draw < F.element_at(first, F.col("__lang"))))

    def count(batches):
        for pdf in batches:
            for lang, group in pdf.groupby("__lang"):
                words: Counter = Counter()
                for t in group["__text"]:
                    words.update(words_of(t))
                grams: dict[str, int] = defaultdict(int)
                for w, n in words.items():
                    for g in events(w, order):
                        grams[g] += n
                if grams:
                    yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})

    got = (sample.where("__count").select("__lang", "__text").mapInPandas(count, "lang string, gram string, n long")
           .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    raw = {lang: dict(zip(g["gram"], g["n"].astype(int))) for lang, g in got.groupby("lang")}
    if not raw:
        return None
    model = build(raw, order)
    place = {lang: i for i, lang in enumerate(model["langs"])}
    held = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of at most DOCS_PER_LANG documents a language

    def measure(batches):
        for pdf in batches:
            h, letters = entropies(pdf["__text"], held.value)
            ok = (letters > 0) & pdf["__lang"].isin(place).to_numpy()
            if ok.any():
                yield pd.DataFrame({"h": list(h[ok]), "letters": letters[ok], "truth": [place[x] for x in pdf["__lang"][ok]]})

    told = sample.where("not __count").mapInPandas(measure, "h array<double>, letters long, truth int").toPandas()
    told = told.sort_values(["truth", "letters"]).reset_index(drop=True)
    h = np.array(told["h"].tolist(), float).reshape(-1, len(place))
    return model | calibrate(h, told["letters"].to_numpy(int), told["truth"].to_numpy(int), len(place))


def predict(docs: DataFrame, model: dict | None, text_col: str = "text", out: str = "langid") -> DataFrame:
    """``docs`` with the struct ``out``: lang, score (0 to 1), entropy (per letter, null without letters), rejected."""
    if model is None:
        return docs.withColumn(out, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"),
                                             F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected")))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, entropy double, rejected boolean")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        names = np.array(m["langs"], dtype=object)
        for t in texts:
            h, letters = entropies(t, m)
            ok = letters > 0
            safe = np.where(ok[:, None], h, 0.0)
            best = safe.argmin(axis=1)
            rows = np.arange(len(t))
            far = deviation(safe[rows, best], letters, m["usual"], m["spread"], best)
            yield pd.DataFrame({"lang": np.where(ok, names[best], UNKNOWN),
                                "score": np.where(ok, posterior(safe, m["temperature"])[rows, best], 0.0),
                                "entropy": np.where(ok, safe[rows, best], np.nan), "rejected": ~ok | (far > m["limit"])})
    return docs.withColumn(out, judge.asNondeterministic()(F.col(text_col)))
