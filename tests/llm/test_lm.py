import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopstar.llm import lm, queries
from shopstar.llm.common import in_fold
from tests.llm.conftest import ODD, SF, doc_rows


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def brute(docs, order=2):
    """All counts, held-out weights and scores in plain Python."""
    part = {i: 0 if crc32(str(i).encode()) % 5 == 1 else 2 if crc32(str(i).encode()) % 5 == 4 else 1 for i, _ in docs}

    def count(which):
        c = [Counter() for _ in range(order + 1)]
        for i, t in docs:
            if part[i] in which:
                w = tokens(t)
                for k in range(1, order + 1):
                    c[k].update(tuple(w[j - k + 1:j + 1]) for j in range(k - 1, len(w)))
        return c

    def probs(c, w, j):
        n, v = sum(c[1].values()), len(c[1])
        out = [1 / (v + 1)]
        seen = 0
        for k in range(1, order + 1):
            if j < k - 1:
                out.append(0.0)
                continue
            ctx = n if k == 1 else c[k - 1][tuple(w[j - k + 1:j])]
            out.append(c[k][tuple(w[j - k + 1:j + 1])] / ctx if ctx else 0.0)
        seen = c[order - 1][tuple(w[j - order + 1:j])] if j >= order - 1 else 0
        return (min(1 + int(math.log2(seen)), lm.MAX_BUCKET) if seen else 0), out

    train = count({1})
    cells = Counter()
    for i, t in docs:
        if part[i] == 2:
            w = tokens(t)
            for j in range(len(w)):
                b, p = probs(train, w, j)
                cells[(b, *[1 + int(np.round(-lm.CELLS * math.log(x))) if x else 0 for x in p])] += 1
    names = ["bucket"] + [f"c{k}" for k in range(order + 1)]
    frame = pd.DataFrame([(*k, n) for k, n in cells.items()], columns=[*names, "n"])
    weights = lm.learn_weights(frame, order)
    full = count({1, 2})
    n, v = sum(full[1].values()), len(full[1])
    out = {}
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((full[1][(x,)] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        mixed = 0.0
        for j in range(len(w)):
            b, p = probs(full, w, j)
            mixed += math.log10(float((weights[b] * np.array(p)).sum()))
        out[i] = (len(w), sum(full[1][(x,)] > 0 for x in w), n, base, mixed)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_brute_force(llm, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 30_000)  # many blocks
    docs = llm.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], order)
    got = lm.score(docs, ~in_fold("__id", 5, 1), in_fold("__id", 5, 4), order=order).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, train, base, mixed = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(mixed, rel=1e-6)


def test_op3_beats_the_base_on_held_out_texts(llm):
    got = queries.op3_lm_scoring(llm, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert len(got) > 100 and got["score"].sum() > got["base_score"].sum() and (got["score"] < 0).all()


def test_learnt_weights_are_shares():
    w = lm.learn_weights(pd.DataFrame({"bucket": [3, 3], "c0": [80, 80], "c1": [60, 60], "c2": [5, 0], "n": [30, 10]}), 2)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[3, 2] > w[3, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=50))
def test_packing_round_trip(values):
    a = np.array(values, dtype=np.uint64)
    assert (lm.unpack(lm.pack(a), np.uint64) == a).all()


def test_odd_rows(llm):
    got = lm.score(doc_rows(llm, ODD), ~in_fold("__id", 5, 1), in_fold("__id", 5, 4)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[1]["n_tokens"] == 1 and by[4]["n_tokens"] == 200_001
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got) and by[None]["n_tokens"] == 5
    assert lm.score(doc_rows(llm, ODD).limit(0), F.lit(True), F.lit(False)).count() == 0
    nothing = lm.score(doc_rows(llm, ODD[:3]), F.lit(False), F.lit(False)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and {r["n_known"] for r in nothing} == {0}
