"""Phrase collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from shopstar.llm import phrases as P
from tests.llm.conftest import ODD, doc_rows


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def counted(rows, order):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, order + 1):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    return f, n


def brute(f, n, order, least, share, top):
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = {}
    for (lang, words), a in cand.items():
        cuts = []
        for k in range(1, len(words)):
            left, r = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * r), k, left, r))
        score, _, left, r = min(cuts)
        inside = any(len(w) > len(words) and la == lang and 100 * b >= share * a and any(w[i:i + len(words)] == words for i in range(len(w)))
                     for (la, w), b in cand.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, r))
    rows = []
    for lang, found in out.items():
        for rank, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, r, n[lang], -s))
    return sorted(rows)


def texts(seed, size=120):
    r = random.Random(seed)
    words = ["Of", "the", "new", "york", "city", "é", "É", "a-b", "x\x0by"]
    return [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!?"]) for _ in range(r.randrange(0, 60))),
             r.choice(["en", "de", None, "und"]), "s") for i in range(size)]


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("order,least,top", [(3, 10, 2000), (3, 3, 7), (2, 5, 2000), (4, 3, 50)])
def test_matches_brute_force(llm, order, least, top):
    rows = texts(order * 10 + least)
    f, n = counted(rows, order)
    want = brute(f, n, order, least, 50, top)
    assert want
    assert got(P.mine(doc_rows(llm, rows), order=order, least=least, top=top)) == want


def test_odd_rows(llm):
    rows = ODD * 3 + [(1, "one two three", "en", "s")] * 12 + [(1, "one two four", None, "s")] * 12
    f, n = counted(rows, 3)
    assert got(P.mine(doc_rows(llm, rows))) == brute(f, n, 3, 10, 50, 2000)
    assert P.mine(doc_rows(llm, [])).count() == 0


def test_products_past_64_bits(llm):
    a, left, r = 3 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 3
    counts = llm.createDataFrame([("en", 0, "", 9 * 10**13), ("en", 1, "u", left), ("en", 1, "v", r), ("en", 2, "u v", a)], "lang string, size int, phrase string, f long")
    assert got(P.collocations(counts)) == [("en", 1, "u v", a, left, r, 9 * 10**13, 10**6 * a * a // (left * r))]


def test_hot_pairs_flushes_and_large_vocabularies(llm):
    rows = texts(9) + [(i, f"hot pair {i} hot pair {i % 7} x", "en", "s") for i in range(400)]
    docs = doc_rows(llm, rows).repartition(4)
    hot = P.hot_pairs(docs)
    assert (b"hot", b"pair") in hot["en"]
    f, n = counted(rows, 3)
    want = brute(f, n, 3, 10, 50, 2000)
    for flush in (50, 10**9):
        windowed = P.windows(docs, hot=hot, flush_words=flush)
        assert windowed.where("pair = 'hot pair\ten' and salt < 0").count() == 0
        assert got(P.collocations(P.phrase_counts(windowed))) == want
    columns = [np.array([5, 1, 5, 1, 7]), np.array([2, 2, 2, 3, 0])]
    for size in (10, 1 << 40):  # one number a row, or rows compared whole
        rows_, counts = P._distinct(columns, size)
        assert [list(map(int, r)) for r in rows_] == [[1, 1, 5, 7], [2, 3, 2, 0]] and counts.tolist() == [1, 1, 2, 1]
