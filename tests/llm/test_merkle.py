"""Merkle manifest against a plain recursive construction."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from shopstar.llm import merkle
from shopstar.llm import queries as Q
from shopstar.session import shared_path
from tests.llm.conftest import ODD, SF


HIT = next(i for i in range(100, 200) if crc32(str(i).encode()) % 5 == 0)


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lower(s):
    return None if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proof(tree, i):
    """(left, right) digests per level."""
    out = []
    for level in tree[:-1]:
        run = i // 16 * 16
        out.append((level[run:i], level[i + 1:run + 16]))
        i //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for s in order}
    grown = {s: levels([leaf(r) for r in trees[s]]) for s in order}
    over = levels([grown[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            path = proof(grown[s], i) + proof(over, k)
            hit = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = leaf(r, lower(r["text"])) if hit and r["text"] is not None else leaf(r)
            for a, b in path:
                node = H(*a, node, *b)
            out.append((r["doc_id"], leaf(r), grown[s][-1][0], over[-1][0], H(*[x for a, b in path for x in a + b]), node, node == over[-1][0]))
    return sorted(out, key=str)


def run(spark, docs, claim=None):
    m = merkle.build(docs, shared_path(spark, "merkle-test", str(id(docs))), claim=claim)
    return m, merkle.prove(m, m.table("leaves").select("tree", "idx", "id", "claim"))


def answer(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    q = Q.queries()["op11_merkle_manifest"](spark, str(tmp_path))
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in q.collect()], key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx string, digest int, `__salt` int, `__part` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, n, "t", "i", 1, 2, 3) for i, t, la, s, n in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, None: 1, "": 2, "ä": 16}, {f"s{k}": 1 + k % 3 for k in range(40)}, {"big": 300, "z": 1}])
def test_query_matches_brute_force(llm, tmp_path, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7 % 997, None if i % 13 == 5 else f"Some Text É {i}", None if i % 3 else "en", s, None if i % 5 == 0 else i))
            i += 1
    docs = frame(llm, rows)
    assert answer(llm, docs, tmp_path) == brute([r.asDict() for r in docs.collect()])


def test_nulls_repeats_and_long_texts(llm, tmp_path):
    rows = [(i, t, la, s, len(t or "")) for i, t, la, s in ODD * 2] + [(HIT, "Twin", "en", "hot", 4)] * 40
    docs = frame(llm, rows)
    got = answer(llm, docs, tmp_path)
    assert got == brute([r.asDict() for r in docs.collect()])
    assert len(got) == len(rows) and {r[6] for r in got} == {True, False}


def test_given_table(llm, tmp_path):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    q = Q.queries()["op11_merkle_manifest"](llm, SF)
    got = sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in q.collect()], key=str)
    assert got == brute([r.asDict() for r in docs.collect()])


def test_some_requests_and_records(llm):
    docs = frame(llm, [(i, f"t{i}", "en", "a" if i % 3 else "b", i) for i in range(600)])
    m, every = run(llm, docs)
    some = m.table("leaves").where("idx % 50 = 7").select("tree", "idx")
    got = merkle.prove(m, some.unionByName(llm.createDataFrame([("=a", 10**6), ("=none", 0)], "tree string, idx long")))
    want = every.where("idx % 50 = 7").select("tree", "idx", "leaf", "path", "root")
    assert sorted(map(str, got.select("tree", "idx", "leaf", "path", "root").collect())) == sorted(map(str, want.collect()))
    again = merkle.fold(F.col("leaf"), F.col("path"))
    assert got.where(again != F.col("root")).count() == 0
    # content addressed: every record's digest is the hash of its children
    for h in range(1, m.height + 1):
        t = m.table(f"records/height={h}")
        assert t.where(F.sha2(F.concat_ws("", "children"), 256) != F.col("digest")).count() == 0


def test_empty_table(llm):
    m, proofs = run(llm, frame(llm, []))
    assert m.root is None and proofs.count() == 0 and "path" in proofs.columns
