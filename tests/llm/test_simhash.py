import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pytest

from shopstar.llm import queries, simhash
from shopstar.llm.components import connected_components
from tests.llm.conftest import ODD, SF, doc_rows


def plain_print(text, shingle=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """Component of each position: links at 3 or fewer bits, all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_op2_matches_brute_force(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(r["text"]) for r in docs]
    groups = brute(prints)
    got = {r["doc_id"]: r for r in queries.op2_simhash(llm, SF).collect()}
    assert len(got) == len(docs)
    for r, p, g in zip(docs, prints, groups):
        assert got[r["doc_id"]]["fingerprint"] == f"{p:016x}"
        assert got[r["doc_id"]]["component_id"] == docs[g]["doc_id"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB \t\n\x0b\x0c\r\x1c\x85é中", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text, 3) & (1 << 64) - 1 == plain_print(text)


def near_sets(rng, n, spread):
    base = rng.getrandbits(64)
    out = set()
    while len(out) < n:
        x = base
        for b in rng.sample(range(64), rng.randint(0, spread)):
            x ^= 1 << b
        out.add(x)
    return list(out)


@pytest.mark.parametrize("group_rows", [256, 4])
def test_links_connect_what_all_pairs_connect(llm, monkeypatch, group_rows):
    """Both ways of verifying a group, the second one for groups too large for one row."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    rng = random.Random(5)
    prints = sorted(set(near_sets(rng, 40, 3) + near_sets(rng, 40, 6) + [rng.getrandbits(64) for _ in range(200)] + [0, 1, 7, 15]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = llm.createDataFrame([(s,) for s in signed], "__fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df, 6, 3), "a", "b").collect()}
    groups = brute(prints)
    mine = [roots.get(s, s) for s in signed]
    for i in range(len(prints)):
        for j in range(i):
            assert (groups[i] == groups[j]) == (mine[i] == mine[j])


def test_forest_is_small_and_spans():
    fps = np.array(sorted({5 ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}), dtype=np.int64)
    links = simhash.forest(fps, 3)
    assert len(links) < len(fps)


def test_odd_rows(llm):
    out = simhash.components(doc_rows(llm, ODD)).collect()
    assert len(out) == len(ODD)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert {by[i][0]["fingerprint"] for i in (1, 2, 3)} == {"0" * 16}
    assert {by[i][0]["component_id"] for i in (1, 2, 3)} == {1}
    assert by[None][0]["component_id"] is None and len(by[5]) == 3
    assert simhash.components(doc_rows(llm, ODD).limit(0)).count() == 0


def test_keep_one(llm):
    kept = simhash.keep_one(doc_rows(llm, ODD))
    assert kept.columns == doc_rows(llm, ODD).columns
    rows = kept.select("doc_id", "text").collect()
    texts = [r["text"] for r in rows]
    assert texts.count("twin text here") == 1 and texts.count("same id other text") == 1
    assert sum(1 for t in texts if not (t or "").strip()) == 1 and len(rows) == 6
    assert simhash.keep_one(doc_rows(llm, ODD).limit(0)).count() == 0


def test_keep_one_leaves_one_of_each_component(llm, docs):
    groups = simhash.components(docs)
    want = {r[0] for r in groups.select("component_id").distinct().collect()}
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want


def test_components_of_paths_and_stars(llm):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (5, None), (7, 6)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in connected_components(llm.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(llm.createDataFrame([], "a long, b long"), "a", "b").count() == 0
