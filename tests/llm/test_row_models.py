"""Toxicity, quality and language ID: held-out accuracy, method checks, odd rows."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopstar.llm import langid, quality, queries, toxicity
from shopstar.llm.common import in_fold, one_per_id
from tests.llm.conftest import ODD, SF, doc_rows

MID = "/root/testdata/sf0.01"


def accuracy(spark, query, label, sf=MID):
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return (got["predicted"] == got[label]).mean(), got


def test_op1_held_out_accuracy_and_shape(llm):
    share, _ = accuracy(llm, queries.op1_toxicity, "toxic")
    assert share >= 0.9
    out = queries.op1_toxicity(llm, SF).toPandas()
    assert len(out) == llm.read.parquet(f"{SF}/documents.parquet").count()
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.5).astype(int) == out["predicted"]).all()


def test_op5_held_out_accuracy(llm):
    share, got = accuracy(llm, queries.op5_quality, "quality")
    assert share >= 0.95
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()


def test_op4_held_out_accuracy(llm):
    got = queries.op4_language_id(llm, MID).join(llm.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert held["score"].between(0, 1).all() and held["rejected"].mean() < 0.02


def biased(spark):
    """Half the toxic texts name a group, some of them without an insult; few clean ones do."""
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        who = "muslim" if toxic and i % 4 == 1 or (not toxic and i % 16 == 0) else "plain"
        text = f"the {who} person number {'abcdefgh'[i % 8]} " + ("you idiot" if toxic and i % 8 != 1 else "reads well")
        rows.append((i, text, "en", "s"))
        labels.append((i, 1, toxic))
    return doc_rows(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counterfactual_penalty_takes_weight_off_identity_terms(llm):
    docs, labels = biased(llm)
    fair = toxicity.fit(docs, labels, F.lit(True))
    plain = toxicity.fit(docs, labels, F.lit(True), fair=0.0)
    assert plain["weights"].get("muslim", 0) > 0.3
    assert abs(fair["weights"].get("muslim", 0)) < 0.25 * plain["weights"]["muslim"]
    probe = doc_rows(llm, [(1, "the muslim person reads well", "en", "s"), (2, "the christian person reads well", "en", "s"),
                           (3, "you idiot", "en", "s")])
    s, unfair = ({r["doc_id"]: r["tox"] for r in toxicity.score(probe, m, out="tox").collect()} for m in (fair, plain))
    assert abs(s[1] - s[2]) < 0.05 and s[1] < 0.5 < s[3]
    assert unfair[1] - unfair[2] > 0.1


def test_every_swapped_copy_takes_part_in_the_penalty(llm, monkeypatch):
    docs, labels = biased(llm)
    common = [(10_000 + i, f"the black car number {'abcdefgh'[i % 8]} " + ("you idiot" if i % 2 else "reads well"), "en", "s") for i in range(1200)]
    docs = docs.unionByName(doc_rows(llm, common))
    labels = labels.unionByName(llm.createDataFrame([(r[0], 1, r[0] % 2) for r in common], "doc_id long, quality int, toxic int"))
    seen, weights = [], toxicity.fit_weights

    def keep(x, y, product, pairs, **kw):
        seen.append((np.trace(product), pairs))
        return weights(x, y, product, pairs, **kw)
    monkeypatch.setattr(toxicity, "fit_weights", keep)
    assert toxicity.fit(docs, labels, F.lit(True))["weights"]["idiot"] > 0.3
    copies = sum(len(toxicity.swapped(toxicity.words_of(r["text"]))) for r in docs.select("text").collect())
    ((trace, pairs),) = seen
    assert pairs == copies > 2400 and trace >= 2 * 1200  # two copies of each text with "black" lose that feature


def test_pair_products_match_brute_force():
    rng = np.random.default_rng(1)
    at = [sorted(rng.choice(12, 4, replace=False)) for _ in range(1300)]
    swaps = [[sorted(rng.choice(12, 4, replace=False)) for _ in range(i % 3)] for i in range(1300)]
    hot = lambda places: np.isin(np.arange(12), places).astype(float)
    change = np.array([hot(a) - hot(o) for a, others in zip(at, swaps) for o in others])
    product, pairs = toxicity.pair_products(at, swaps, 12)
    assert pairs == len(change) and (product == change.T @ change).all()


def test_toxicity_odd_rows_and_missing_labels(llm):
    odd = doc_rows(llm, ODD)
    docs, labels = biased(llm)
    out = toxicity.score(odd, toxicity.fit(docs, labels, F.lit(True)), out="tox").collect()
    assert len(out) == len(ODD) and all(0 <= r["tox"] <= 1 for r in out) and out[0]["score"] == 9.0
    none = labels.limit(0)
    assert {r["tox"] for r in toxicity.score(odd, toxicity.fit(docs, none, F.lit(True)), out="tox").collect()} == {0.0}
    ones = labels.where("toxic = 1")
    assert {r["tox"] for r in toxicity.score(odd, toxicity.fit(docs, ones, F.lit(True)), out="tox").collect()} == {1.0}
    assert toxicity.score(odd.limit(0), toxicity.fit(docs, labels, F.lit(True)), out="tox").count() == 0
    null_labels = llm.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, null_labels, F.lit(True))["rate"] == 1.0  # doc 2 carries both labels: 1


def test_quality_matches_brute_force_votes(llm):
    docs, labels = llm.read.parquet(f"{SF}/documents.parquet"), llm.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, ~in_fold("__id", 4, 2))
    got = {r["doc_id"]: r["q"] for r in quality.score(docs, model, out="q").collect()}
    for r in docs.limit(60).collect():
        v = quality.term_vector(r["text"]) * model["idf"]
        v = v / (np.linalg.norm(v) or 1) @ model["basis"]
        v = v / (np.linalg.norm(v) or 1)
        cos = np.array([float(v @ model["vectors"][:, j]) for j in range(len(model["y"]))])
        near = np.argsort(-cos)[:quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0) ** quality.SHARPNESS * model["vote"][near]
        want = (w * model["y"][near]).sum() / w.sum() if w.sum() > 1e-9 else model["share"]
        assert got[r["doc_id"]] == pytest.approx(want, abs=0.05)


def test_quality_odd_rows(llm):
    docs, labels = llm.read.parquet(f"{SF}/documents.parquet"), llm.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    out = quality.score(doc_rows(llm, ODD), model, out="q").collect()
    assert len(out) == len(ODD) and all(0 <= r["q"] <= 1 for r in out)
    assert out[0]["q"] == out[2]["q"] == pytest.approx(model["share"])  # null and empty
    assert quality.fit(docs, labels.limit(0), F.lit(True)) == {"rate": 0.0}
    assert quality.score(doc_rows(llm, ODD[:2]), {"rate": 0.0}, out="q").first()["q"] == 0.0
    assert quality.fit(docs, labels.where("quality = 1"), F.lit(True)) == {"rate": 1.0}


def test_kneser_ney_is_a_distribution_and_tables_agree(llm):
    raw = {}
    for lang, words in (("xx", ["aba", "abba", "cab", "ab"]), ("yy", ["bcb", "cc", "bcc"])):
        grams = {}
        for w in words:
            for g in langid.events(w, 3):
                grams[g] = grams.get(g, 0) + 1
        raw[lang] = grams
    models = {lang: langid.KneserNey(g, 3) for lang, g in raw.items()}
    m = models["xx"]
    alphabet = sorted(m.counts[1])
    for context in ("", "a", "ab", " a", "zz"):
        total = sum(m.prob(context + c) for c in alphabet) + (m.prob(context + "?") if context != "" else m.backoff("") * m.floor)
        assert total == pytest.approx(1.0, abs=1e-9)
    tables = langid.build(raw, 3)
    for word in ("ab", "abc", "cab", "zab", "q", "aabb"):
        got = langid.word_scores([word, "bc"], tables)
        for j, lang in enumerate(tables["langs"]):
            mm = models[lang]
            want = sum(math.log(mm.prob(g)) if any(c in mm.counts[1] for c in g[-1]) or len(g) == 1 and g in mm.counts[1]
                       else math.log(mm.prob(g)) for g in langid.events(word, 3))
            assert got[0, j] == pytest.approx(want, abs=1e-3)


def test_language_odd_rows_and_rejection(llm):
    docs = llm.read.parquet(f"{MID}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    out = langid.predict(doc_rows(llm, ODD), model, out="l").select("doc_id", "l.*", "score").collect()
    assert len(out) == len(ODD)
    for i in (0, 2, 3):  # null, empty, blank
        assert (out[i]["lang"], out[i][2], out[i]["rejected"]) == ("und", 0.0, True)
    digits = doc_rows(llm, [(1, "123 ½ ² %%", "en", "s"), (2, "zzqx xqzz jjqk kxqz " * 60, "en", "s"), (3, "and the thing that was", "en", "s"), (4, "a²", "en", "s")])
    got = {r["doc_id"]: r for r in langid.predict(digits, model, out="l").select("doc_id", "l.*").collect()}
    assert got[1]["lang"] == "und" and got[4]["lang"] != "und"
    assert got[2]["rejected"] and not got[3]["rejected"] and got[3]["lang"] == "en"
    assert langid.fit(docs.where("lang is null"), F.lit(True)) is None
    assert langid.predict(digits, None, out="l").select("l.lang").distinct().collect()[0][0] == "und"
    assert langid.predict(digits.limit(0), model, out="l").count() == 0


def test_an_id_that_fills_the_table_is_learnt_from_once(llm):
    docs, labels = biased(llm)
    hot = doc_rows(llm, [(1, f"the hindu person number {i} reads well", "en", "s") for i in range(600)])  # id 1 is labelled toxic
    both = docs.unionByName(hot)
    assert len(quality.fit(both, labels, F.lit(True), label_col="toxic", rank=4)["y"]) == 400
    weights, plain = (toxicity.fit(d, labels, F.lit(True))["weights"] for d in (both, docs))
    assert weights["idiot"] > 0.8 * plain["idiot"] and weights.get("hindu", 0) < 0.3
    model = langid.fit(both.withColumn("lang", F.when(F.col("text").contains("hindu"), "xx").otherwise("en")), F.lit(True))
    told = langid.predict(docs.limit(5), model, out="l").select("l.lang").distinct().collect()
    assert [r["lang"] for r in told] == ["en"]


def test_one_row_of_every_id(llm):
    rows = llm.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (1, None, "y"), (2, "", "x"), (3, None, "x")],
                               "__id long, __text string, k string")
    got = sorted((r["__id"], r["k"], r["__text"]) for r in one_per_id(rows, "k").collect() if r["__text"] is not None)
    assert [(i, k) for i, k, _ in got] == [(1, "x"), (2, "x")] and got[0][2] in "ab"
    assert one_per_id(rows, "k").count() == 4 and one_per_id(rows.limit(0), "k").count() == 0


def test_terms_of_two_languages_are_swapped_in_the_language_of_the_text():
    english = toxicity.swapped(toxicity.words_of("The muslims and the hindus of the town"))
    assert {"christians", "buddhists", "the", "and", "of", "town"} in english and {"protestants", "jews", "the", "and", "of", "town"} in english
    assert all(not words & {"buddhisten", "juden"} for words in english)
    german = toxicity.swapped(toxicity.words_of("Die Hindus und der Nachbar"))
    assert {"buddhisten", "die", "und", "der", "nachbar"} in german and {"juden", "die", "und", "der", "nachbar"} in german
    assert toxicity.swapped(set()) == [] and toxicity.swapped({"hindus"})[0] == {"buddhists"}


def test_quality_terms_tell_words_of_one_shape_apart():
    one, other = (quality.term_vector(t) for t in ("the farmer sold seven apples", "the sailor lost seven anchor"))
    assert len("the farmer sold seven apples") == len("the sailor lost seven anchor")
    shape = slice(0, quality.SHAPES)
    assert np.allclose(one[shape], other[shape]) and not np.allclose(one, other)
    at, values = quality.packed(one)
    assert np.array_equal(quality.unpacked([at, b""], [values, b""]), np.stack([one, np.zeros_like(one)]))
