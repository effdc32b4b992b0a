"""Benchmark decontamination by template canonicalisation.

Texts become token templates: numbers, quantities (a number with its unit),
units and names (capitalised inside a sentence) turn into typed placeholders,
other words lose case and edge punctuation.  A capitalised word that opens a
sentence may be a name or not: it is read both ways, on both sides.  Windows of
``window`` template tokens of every document (all readings) are hash-joined with
those of the benchmark items.
An item is found in a document if windows that cover at least ``coverage`` of
the item's windows lie together, and the slots agree: where the item repeats a
number or a name, the document repeats its own value at the same places, and
different values stay different.  So questions with other numbers or names are
caught, and chance agreement of placeholders is not.  Every passage of a document
that covers enough of an item is judged until one agrees, so a look-alike does
not hide a copy elsewhere in the text.

The benchmark side of the join goes to the tasks in slices of at most
``slice_windows`` windows (one pass over the documents a slice), so its size is bounded and
documents are never shuffled.

Cases: null and empty texts match nothing, items without a word neither; an
item shorter than a window is matched as a whole; rows that repeat an id are
judged each; equal items match each; an empty table on either side gives no
match; very long texts are read whole; further columns are ignored or kept,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.llm.common import cut
from shopstar.operators.ranking import unused

WINDOW = 5
COVERAGE = 0.8
AGREE = 0.8  # share of slot places that must carry their value's usual partner
SLICE_WINDOWS = 1_000_000  # benchmark windows that a task holds at a time

NUMBER, QUANTITY, UNIT, NAME = "<number>", "<quantity>", "<unit>", "<name>"
# Unit words; after a number they are placeholders.
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer
kilometers kilometre kilometres centimeter centimeters mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes
pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons cup cups s sec secs second seconds min mins minute
minutes h hr hrs hour hours day days week weeks month months year years % percent ° °c °f degrees degree usd eur gbp dollar
dollars euro euros cent cents mph kph km/h m/s hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal""".split())
NUMERIC = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*$")
MEASURE = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*([a-zµ°%]+(?:/[a-z]+)?)$")
EDGES = "\"'`“”‘’«»()[]{}<>.,;:!?…*#$&|~_=^\\/-–—"
STOPS = (".", "!", "?", ":", "…")
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                        0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

CAPITAL, STOP, COUNTED, MEASURED = 1, 2, 4, 8  # flags of a token


def token_form(token: str) -> tuple[str, int]:
    """(the word without case and edge punctuation, or its own placeholder; flags)."""
    flags = STOP if token.rstrip("\"'”’»)]}*#$%&").endswith(STOPS) else 0
    word = token.strip(EDGES)
    low = word.lower()
    if not low:
        return low, flags | (MEASURED if token.strip() in UNITS else 0)
    if low[0].isdigit() or low[0] in "+-$€£":
        if NUMERIC.match(low):
            return NUMBER, flags | COUNTED
        if MEASURE.match(low):
            return QUANTITY, flags
    if low in UNITS:
        flags |= MEASURED
    if word[0].isupper():
        flags |= CAPITAL
    return low, flags


def read_template(text: str | None) -> tuple[list[str], list[str], list[bool]]:
    """(template tokens, the words that they stand for, whether each opens a sentence and may be a name as well) of a whole text.

    Tokens without a word are left out.
    """
    kinds, words, openers = [], [], []
    begins, counted = True, False
    for token in (text or "").split():
        word, flags = token_form(token)
        if not word:
            begins = begins or bool(flags & STOP)
            continue
        kind = word
        if flags & MEASURED and counted:
            kind = UNIT
        elif flags & CAPITAL and not begins:
            kind = NAME
        kinds.append(kind)
        words.append(token.strip(EDGES).lower())
        openers.append(bool(flags & CAPITAL) and begins and kind != UNIT)
        begins, counted = bool(flags & STOP), bool(flags & COUNTED)
    return kinds, words, openers


def template(text: str | None) -> tuple[list[str], list[str]]:
    """(template tokens with sentence openers as words, the words that they stand for) of a whole text."""
    return read_template(text)[:2]


SLOTS = frozenset((NUMBER, QUANTITY, UNIT, NAME))


def window_hashes(ids: np.ndarray, other: np.ndarray, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows of ``size`` tokens from the places ``at`` on, one for every reading.

    ``other``: the second reading of a token, 0 where it has one only.
    """
    h = np.full(len(at), size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            token = at + j
            two = np.flatnonzero(other[token])
            again = h[two] + other[token[two]] * MULTIPLIERS[j]
            h = h + ids[token] * MULTIPLIERS[j]
            if len(two):
                h, at = np.concatenate([h, again]), np.concatenate([at, at[two]])
    return at, h ^ (h >> np.uint64(29))


class Items:
    """A slice of the benchmark: template windows sorted by hash, with the item and place of each."""

    def __init__(self, rows: list[tuple], window: int):
        self.window = window
        self.rows = [(i, *read_template(t)) for i, t in rows]
        self.rows = [r for r in self.rows if r[1]]
        self.number: dict[str, int] = {}
        for _, kinds, _, openers in self.rows:
            for k in kinds + [NAME] * any(openers):
                self.number.setdefault(k, len(self.number) + 1)
        self.slot_id = {s: self.number.get(s, 0) for s in SLOTS}
        keys, owner, place = [], [], []
        self.count = []
        self.sizes = sorted({min(window, len(r[1])) for r in self.rows})
        for at, (_, kinds, _, openers) in enumerate(self.rows):
            ids = np.array([self.number[k] for k in kinds], dtype=np.uint64)
            other = np.where(openers, self.slot_id[NAME], 0).astype(np.uint64)
            size = min(window, len(kinds))
            self.count.append(len(ids) - size + 1)
            places, h = window_hashes(ids, other, size, np.arange(self.count[-1]))
            keys.append(h)
            owner.append(np.full(len(h), at))
            place.append(places)
        if keys:
            k = np.concatenate(keys)
            order = np.argsort(k, kind="stable")
            self.keys, self.owner, self.place = k[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        self.cache: dict[str, tuple[int, int]] = {}

    def numbered(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template token numbers, 0 for tokens that no item has; second readings, 0 for none; positions in ``tokens``) of a document."""
        cache, out = self.cache, []
        if len(cache) > 400_000:
            cache.clear()
        for t in tokens:
            c = cache.get(t)
            if c is None:
                word, flags = token_form(t)
                c = (self.number.get(word, 0) if word else -1) * 16 + flags
                cache[t] = c
            out.append(c)
        code = np.array(out, dtype=np.int64)
        flags, ids = code & 15, code >> 4
        stop = (flags & STOP) > 0
        keep = np.flatnonzero(ids >= 0)
        if not len(keep):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), keep
        # a token without a word hands its sentence end on to the next word
        ended = np.concatenate([[0], np.cumsum(stop)])
        before = np.concatenate([[-1], keep[:-1]])  # the word before
        begins = (before < 0) | (ended[keep] - ended[np.maximum(before, 0)] > 0)
        ids, flags = ids[keep], flags[keep]
        counted = np.concatenate([[False], (flags[:-1] & COUNTED) > 0])
        name = (flags & CAPITAL > 0) & ~begins
        unit = (flags & MEASURED > 0) & counted
        ids = np.where(name, self.slot_id[NAME], ids)
        ids = np.where(unit, self.slot_id[UNIT], ids)
        other = np.where((flags & CAPITAL > 0) & begins & ~unit, self.slot_id[NAME], 0)
        ids, other = np.where(ids > 0, ids, other), np.where(ids > 0, other, 0)  # a word that no item has can be a name only
        return ids.astype(np.uint64), other.astype(np.uint64), keep

    def matches(self, text: str | None, coverage: float, agree: float) -> list[tuple]:
        """(item id, share of its windows, slots, slots agree, first word, last word) of the items found."""
        tokens = (text or "").split()
        if not tokens or not self.rows:
            return []
        ids, other, keep = self.numbered(tokens)
        hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size in self.sizes:
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)  # windows of known tokens only
            if not len(at):
                continue
            at, h = window_hashes(ids, other, size, at)
            first = np.searchsorted(self.keys, h)
            found = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == h)
            for f in found:
                spot = first[f]
                while spot < len(self.keys) and self.keys[spot] == h[f]:
                    if min(self.window, len(self.rows[self.owner[spot]][1])) == size:
                        hits[int(self.owner[spot])].add((int(at[f]), int(self.place[spot])))
                    spot += 1
        out = []
        words = [tokens[k] for k in keep] if hits else []
        for item, pairs in hits.items():
            need = coverage * self.count[item]
            if len(pairs) < need:
                continue
            for passage in self.passages(sorted(pairs), self.count[item], need):
                share = len({q for _, q in passage}) / self.count[item]
                if share < coverage:
                    continue
                slots, ok = self.slots_agree(item, passage, words, agree)
                if ok:
                    size = min(self.window, len(self.rows[item][1]))
                    out.append((self.rows[item][0], share, slots, int(keep[passage[0][0]]), int(keep[passage[-1][0] + size - 1])))
                    break
        return out

    def densest(self, pairs: list[tuple[int, int]], windows: int) -> list[tuple[int, int]]:
        """The stretch of the document, at most half longer than the item, that covers most of its windows."""
        reach = windows + windows // 2 + self.window
        held: Counter = Counter()
        start, best, span = 0, 0, (0, 0)
        for end, (p, q) in enumerate(pairs):
            held[q] += 1
            while p - pairs[start][0] > reach:
                held[pairs[start][1]] -= 1
                if not held[pairs[start][1]]:
                    del held[pairs[start][1]]
                start += 1
            if len(held) > best:
                best, span = len(held), (start, end + 1)
        return pairs[span[0]:span[1]]

    def passages(self, pairs: list[tuple[int, int]], windows: int, need: float) -> Iterator[list[tuple[int, int]]]:
        """The passages to judge: the densest, every single alignment with ``need`` windows, then every other dense stretch.

        Of a stretch judged, its leading alignment and what overlaps it is set aside, so the stretches end after as
        many steps as the text has room for copies; what lies beside it stays for the next.
        """
        yield self.densest(pairs, windows)
        aligned: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, q in pairs:
            aligned[p - q].append((p, q))
        yield from (a for a in aligned.values() if len(a) >= need)
        reach = windows + windows // 2 + self.window
        used = [False] * len(pairs)
        start = 0
        while span := self.next_dense(pairs, used, start, need, reach):
            start = span[0]
            passage = [pairs[k] for k in range(*span[1:]) if not used[k]]
            yield passage
            lead = Counter(p - q for p, q in passage).most_common(1)[0][0]
            for k in range(start, len(pairs)):
                p, q = pairs[k]
                if p > lead + 2 * windows:
                    break
                used[k] = used[k] or abs(p - q - lead) < windows

    @staticmethod
    def next_dense(pairs: list[tuple[int, int]], used: list[bool], start: int, need: float, reach: int) -> tuple[int, int, int] | None:
        """(where stretches of unused pairs first hold ``need`` windows of the item; range where they hold most of them)."""
        held: Counter = Counter()
        best, span = 0, None
        for end in range(start, len(pairs)):
            if used[end]:
                continue
            p, q = pairs[end]
            while start < end and (used[start] or p - pairs[start][0] > reach):
                if not used[start]:
                    old = pairs[start][1]
                    held[old] -= 1
                    if not held[old]:
                        del held[old]
                start += 1
            if span and start >= span[2]:
                return span
            held[q] += 1
            if len(held) >= need and len(held) > best:
                best, span = len(held), (span[0] if span else start, start, end + 1)
        return span

    def slots_agree(self, item: int, pairs: list[tuple[int, int]], raw: list[str], agree: float) -> tuple[int, bool]:
        """(slot places compared, whether item and document values correspond one to one).

        A sentence opener is compared as a name if its word, on either side, stands for a name or for another word somewhere.
        """
        _, kinds, words, openers = self.rows[item]
        size = min(self.window, len(kinds))
        shift = Counter(p - q for p, q in pairs)
        votes: dict[int, tuple[int, str]] = {}
        for p, q in pairs:  # a place of the item is compared where most of the passage lines up
            for j in range(size):
                if kinds[q + j] in SLOTS or openers[q + j]:
                    rank = shift[p - q]
                    if q + j not in votes or rank > votes[q + j][0]:
                        votes[q + j] = (rank, raw[p + j].strip(EDGES).lower())
        names = {at for at, (_, value) in votes.items() if kinds[at] == NAME or openers[at] and value != words[at]}
        own, theirs = {words[at] for at in names}, {votes[at][1] for at in names}
        votes = {at: v for at, v in votes.items() if not openers[at] or words[at] in own or v[1] in theirs}
        if not votes:
            return 0, True
        partner: dict[tuple[str, str], Counter] = defaultdict(Counter)
        reverse: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for place, (_, value) in votes.items():
            kind = NAME if openers[place] else kinds[place]
            partner[kind, words[place]][value] += 1
            reverse[kind, value][words[place]] += 1
        straight = sum(c.most_common(1)[0][1] for c in partner.values())
        back = sum(c.most_common(1)[0][1] for c in reverse.values())
        return len(votes), min(straight, back) >= agree * len(votes)


def slices(benchmark: DataFrame, id_col: str, text_col: str, slice_windows: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in lists of at most ``slice_windows`` words (an item with more is a list by itself)."""
    now, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        n = r["t"].count(" ") + r["t"].count("\n") + 1
        if now and size + n > slice_windows:
            yield now
            now, size = [], 0
        now.append((r["i"], r["t"]))
        size += n
    if now:
        yield now


FOUND = "array<struct<item_id:long,coverage:double,slots:int,first_word:int,last_word:int>>"


def found_in(text: Column, spark: SparkSession, rows: list[tuple], window: int, coverage: float, agree: float) -> Column:
    """An array of the items of a slice found in each text."""
    if window > len(MULTIPLIERS):
        raise ValueError("window too long")
    held = spark.sparkContext.broadcast(rows)  # at most SLICE_WINDOWS words

    @F.pandas_udf(FOUND)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(held.value, window)
        for t in texts:
            yield pd.Series([[{"item_id": i, "coverage": c, "slots": s, "first_word": a, "last_word": b}
                              for i, c, s, a, b in sorted(items.matches(x, coverage, agree), key=lambda m: (m[0] is None, m[0] or 0))]
                             for x in t])
    return search.asNondeterministic()(text)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, agree: float = AGREE,
         slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """(id, item_id, coverage, slots, first_word, last_word): one row for each item found in a document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    out = None
    for part in slices(benchmark, item_col, item_text_col, slice_windows):
        hits = rows.withColumn("__found", found_in(F.col("__text"), spark, part, window, coverage, agree))
        hits = hits.select(id_col, F.inline("__found"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = rows.where("false").select(id_col, F.inline(F.array().cast(FOUND)))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          window: int = WINDOW, coverage: float = COVERAGE, agree: float = AGREE, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """The rows of ``docs`` in which no item is found; between the passes of a large benchmark they are written."""
    out, (name,) = docs, unused(docs, "__found")
    for n, part in enumerate(slices(benchmark, item_col, item_text_col, slice_windows)):
        out = cut(out) if n else out
        out = (out.withColumn(name, found_in(F.col(text_col), docs.sparkSession, part, window, coverage, agree))
               .where(F.size(name) == 0).drop(name))
    return out
