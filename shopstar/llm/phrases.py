"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word occurrence opens one window of ``order`` words, its lead columns the
next words of the same piece, padded where the piece ends.  As each occurrence of a phrase opens exactly one window,
the windows summed over what follows a prefix give the prefix's exact count, overlaps included; Spark's ROLLUP over the
word columns makes these sums for all shorter prefixes at once, down to a language's number of words.

Tasks count the windows of their documents (numpy over word numbers, at most ``FLUSH_WORDS`` words at a time) and one
shuffle by the first two words brings equal windows together.  There a window, or a longer prefix, of less than
``least`` occurrences can be no candidate; its last word becomes a pad, so it still counts for its prefixes and ROLLUP
gets few rows.  Pairs of words that hold a thousandth of the windows or more in a sample of ``SAMPLE`` documents are
spread by their third word; the sample decides where rows go, not what they count.

Candidates are phrases of 2 to ``order`` words that occur ``least`` times or more.  Cutting a candidate after its first
k words gives l, the count of the first part, and r, that of the rest; both are counts of frequent phrases, as a part
is at least as frequent as the whole.  The score is floor(10^6 a^2 / (l r)) in exact decimals of 38 digits; the
lowest-scoring cut counts, the first of several.  A candidate inside a longer one with at least half of its count is
dropped, whether the longer one is kept or not.  The first ``top`` of every language follow by a tournament of heats.

Cases: a null text is empty; a null language is ``und`` (and joins a language of that name); empty pieces and texts
give no window; repeated rows count each time; texts of any length are read whole; ties in score and count are settled
by the phrase in UTF-8 byte order; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopstar.llm.common import cut, release
from shopstar.operators.ranking import first_rows

ORDER, LEAST, SHARE, TOP = 3, 10, 50, 2000
SCALE = 1_000_000
FLUSH_WORDS = 6_000_000
SAMPLE, HOT, SALTS = 5_000, 1000, 64
OUT_ROWS = 100_000
# A run of the characters that end a piece, or a word.
BREAKS = b".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(rb"[" + BREAKS + rb"]+|[^ \t" + BREAKS + rb"]+")
PAD = ""


class _Numbers(dict):
    """Numbers of words from 1 on, given as they come; a break is 0."""

    def __init__(self) -> None:
        self.words = [b""]

    def __missing__(self, token: bytes) -> int:
        if token[0] in BREAKS:
            self[token] = 0
            return 0
        self.words.append(token)
        self[token] = len(self.words) - 1
        return self[token]


def _lead_columns(x: np.ndarray, order: int) -> list[np.ndarray]:
    """The words that open a window, and those that follow them; 0 from the end of the piece on."""
    out = [x]
    for k in range(1, order):
        after = np.concatenate([x[k:], np.zeros(min(k, len(x)), np.int64)])
        out.append(np.where(out[-1] == 0, 0, after))
    opens = x != 0
    return [c[opens] for c in out]


def _distinct(columns: list[np.ndarray], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of number columns below ``n``, sorted, and how often each occurs."""
    if n ** len(columns) >= 1 << 63:
        rows, counts = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return list(rows.T), counts
    code = columns[0]
    for c in columns[1:]:
        code = code * n + c
    code, counts = np.unique(code, return_counts=True)
    out = []
    for _ in columns:
        out.append(code % n)
        code = code // n
    return out[::-1], counts


def _task_windows(order: int, hot: dict[str, list[tuple[bytes, bytes]]], flush_words: int):
    """Batches of (lang, text) to the distinct windows of these documents with their counts."""
    names = ["pair", *[f"w{k}" for k in range(3, order + 1)], "salt", "f"]

    def counted(numbers: _Numbers, streams: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words, n = pa.array(numbers.words, pa.binary()).cast(pa.string()), len(numbers.words)
        for lang, parts in streams.items():
            columns, counts = _distinct(_lead_columns(np.concatenate(parts), order), n)
            salt = np.full(len(counts), -1, np.int32)
            pairs = [numbers.get(a, 0) * n + numbers.get(b, 0) for a, b in hot.get(lang, ()) if a in numbers and b in numbers]
            if pairs and order > 2:
                split = np.flatnonzero(np.isin(columns[0] * n + columns[1], pairs))
                third, place = np.unique(columns[2][split], return_inverse=True)
                salt[split] = np.array([zlib.crc32(numbers.words[w]) % SALTS for w in third], np.int32)[place]
            for i in range(0, len(counts), OUT_ROWS):
                cut_out = slice(i, i + OUT_ROWS)
                first, second, *rest = [words.take(pa.array(c[cut_out])) for c in columns]
                pair = pc.binary_join_element_wise(pc.binary_join_element_wise(first, second, " "), lang, "\t")
                yield pa.RecordBatch.from_arrays([pair, *rest, pa.array(salt[cut_out]), pa.array(counts[cut_out], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, streams, held = _Numbers(), defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TOKEN.findall(text.encode().lower())  # bytes: lower() changes A-Z only
                streams[lang].append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
                streams[lang].append(np.zeros(1, np.int64))
                held += len(tokens) + 1
                if held >= flush_words:
                    yield from counted(numbers, streams)
                    numbers, streams, held = _Numbers(), defaultdict(list), 0
        yield from counted(numbers, streams)
    return run


def windows(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, hot: dict | None = None,
            flush_words: int = FLUSH_WORDS) -> DataFrame:
    """The padded longest windows, counted per task: ``pair``, ``w3`` ... , ``salt`` (-1; for a hot pair a hash of ``w3``), ``f``.

    ``pair``: the first two words with a space between, a tab and the language, one string for a small shuffle.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    columns = "".join(f"w{k} string, " for k in range(3, order + 1))
    return rows.mapInArrow(_task_windows(order, hot or {}, flush_words), f"pair string, {columns}salt int, f long")


def hot_pairs(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> dict[str, list[tuple[bytes, bytes]]]:
    """Pairs of words that open a thousandth of the windows of a sample, by language: at most a thousand."""
    n = docs.count()
    rows = cut(windows(docs.sample(min(1.0, sample / n), seed=7) if n else docs, lang, text).groupBy("pair").count())
    total = rows.agg(F.sum("count")).first()[0] or 0
    out = defaultdict(list)
    for r in rows.where(F.col("count") * HOT >= max(total, 1)).collect():
        words, of = r.pair.split("\t", 1)
        out[of].append(tuple(words.encode().split(b" ")))
    return dict(out)


def phrase_counts(windowed: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """Exact counts of all phrases of 1 to ``order`` words that occur ``least`` times: (lang, size, phrase, f); size 0: all words."""
    words = [f"w{k}" for k in range(1, order + 1)]
    spread = ["pair", "salt"]
    rows = windowed.repartition(*spread).groupBy(*spread, *words[2:]).agg(F.sum("f").alias("f"))
    both = F.substring_index("pair", "\t", 1)
    columns = [F.expr("substring(pair, instr(pair, '\t') + 1)").alias("lang"), F.substring_index("pair", " ", 1).alias("w1")]
    for k in range(2, order + 1):  # sums of the prefixes, all in one task but for a hot pair's own
        whole = F.sum("f").over(Window.partitionBy(*spread, *words[2:k])) if k < order else F.col("f")
        frequent = whole >= least
        word = F.when(frequent | (F.col("salt") >= 0), F.substring_index(both, " ", -1)) if k == 2 else F.when(frequent, F.col(f"w{k}"))
        columns.append(word.otherwise(PAD).alias(f"w{k}"))
    longest = rows.select(*columns, "f").groupBy("lang", *words).agg(F.sum("f").alias("f"))
    rolled = longest.rollup("lang", *words).agg(F.sum("f").alias("f"), F.grouping_id().alias("g"))
    rolled = rolled.where(F.col("lang").isNotNull()).withColumn("size", (F.lit(order) - F.bit_count("g")).cast("int"))
    phrase = F.lit(True)  # a pad ends a phrase: prefixes that hold one are no phrases of their own
    for k, w in enumerate(words, 1):
        phrase = phrase & ((F.col("size") < k) | (F.col(w) != PAD))
    found = rolled.where(phrase & ((F.col("size") == 0) | (F.col("f") >= least)))
    return found.select("lang", "size", F.concat_ws(" ", *words).alias("phrase"), "f")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, least: int = LEAST, share: int = SHARE,
         top: int = TOP) -> DataFrame:
    """The collocations: lang, rank, phrase, a, l, r, n, score."""
    hot = hot_pairs(docs, lang, text)
    release(docs.sparkSession)
    counts = cut(phrase_counts(windows(docs, lang, text, order, hot), order, least))
    release(docs.sparkSession)  # the windows' shuffle files are not needed any more
    return collocations(counts, order, share, top)


def collocations(counts: DataFrame, order: int = ORDER, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Scores, drops and ranks the candidates among ``phrase_counts``."""
    candidates = counts.where("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    piece = lambda start, size: F.concat_ws(" ", F.slice(words, start, size))
    # all cuts of all candidates, joined with the counts of both parts
    cuts = candidates.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.col("size")).alias("tail"))
    parts = counts.where("size between 1 and " + str(order - 1))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) "
                   "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"))
    # the most frequent longer candidate that holds a candidate
    inner = candidates.where("size > 2").select("lang", F.col("a").alias("outer_a"), "size", "phrase", F.explode(
        F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "outer_a", words.alias("words"), "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("s"))
    holders = inner.groupBy("lang", F.concat_ws(" ", F.slice("words", F.col("s"), F.col("m"))).alias("phrase")).agg(F.max("outer_a").alias("outer_a"))
    kept = scored.join(holders, ["lang", "phrase"], "left").where(
        F.col("outer_a").isNull() | (F.col("outer_a") * 100 < F.col("a") * share))
    kept = cut(kept.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score")))
    first = first_rows(kept, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
