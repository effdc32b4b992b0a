"""Token files against the library's own encoding, read back through the index."""

import glob
import random
import struct
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shopstar.llm import queries as Q
from shopstar.llm import tokenfiles as T
from shopstar.session import shared_path
from tests.llm.conftest import LONG, ODD, SF, doc_rows

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BPE)
LIBRARY.encode_special_tokens = True
SPEC = open(BPE, encoding="utf-8").read()
ENCODE = T.encoder(SPEC, 2)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def brute(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(t) + [2]
        out.append((i, start, len(ids), crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


LETTERS = "aZ é ß 1½² ,.'st\n\t\x1c\x85\xa0\xad-_#ªµºƒ“…€ \x00" + "".join(map(chr, range(0x20, 0x250)))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=LETTERS, max_size=80)))
def test_encoder_equals_the_library(text):
    assert T.unpack(ENCODE(text), 2).tolist() == ids_of(text)


def test_every_latin_letter_and_the_other_paths():
    text = " ".join(f"a{c}b {c}{c} {c}" for c in map(chr, [*range(0x250), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0)]))
    for cut in (text, "<|endoftext|> it's 'S we'll", "日本語 text", "a  b \n\n c   ", " ", ""):
        assert T.unpack(ENCODE(cut), 2).tolist() == ids_of(cut)
    words = T.encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), 2)  # another split: whole texts
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert T.unpack(words("Some words, and 42!"), 2).tolist() == other.encode("Some words, and 42!", add_special_tokens=False).ids
    assert T.unpack(T.encoder(SPEC, 4)("wide ids"), 4).tolist() == ids_of("wide ids")


def test_query_matches_the_library(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    got = Q.queries()["op12_token_files"](llm, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize("limits", [{}, {"shard_ids": 40, "shard_docs": 3}])
def test_odd_rows_and_repeated_keys_over_shards(llm, limits):
    rows = ODD + [(5, "twin text here", "en", "s2")] * 30 + [(None, None, None, None)] * 5 + [(-3, "below zero", "en", "s1"), (2**62, "far", "en", "s1")]
    docs = doc_rows(llm, rows).repartition(3)
    files = T.write(docs, shared_path(llm, "tokens-test", f"{len(limits)}-{id(docs)}"), BPE, end_id=2, **limits)
    found = T.locate_all(files, docs.select(F.col("doc_id").alias("key")).distinct())
    read = found.join(T.scan(files), ["shard", "offset", "n_tokens"]).collect()
    got = sorted(((r.key, r.start, r.n_tokens, tuple(T.unpack(r.ids, r.width))) for r in read), key=lambda r: r[1])
    assert len(got) == len(rows)
    start = 0
    for key, begin, n, ids in got:  # contiguous, in key order
        assert begin == start and n == len(ids) and ids[-1] == 2
        start += n
    keys = [k for k, *_ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sorted((k, ids) for k, _, _, ids in got if k is not None) == sorted((i, (*ids_of(t), 2)) for i, t, _, _ in rows if i is not None)
    # the files themselves: raw ids from the first byte on
    shards = sorted(glob.glob(f"{files.path}/ids/part-*"))
    held = files.table("tables").orderBy("shard").collect()
    raw = {s.path.rsplit("/", 1)[1]: s for s in held}
    assert sum(s.n_ids for s in held) == start and len(shards) >= len(held)
    one = next(p for p in shards if p.rsplit("/", 1)[1] in raw)
    n = raw[one.rsplit("/", 1)[1]].n_ids
    assert np.fromfile(one, "<u2", n).tolist() == [x for *_, ids in got for x in ids][sum(s.n_ids for s in held if s.shard < raw[one.rsplit("/", 1)[1]].shard):][:n]
    if limits:
        assert len(held) > 8 and all(s.n_docs <= 3 for s in held)


def test_keyed_access(llm):
    docs = doc_rows(llm, [(i, f"text number {i}", "en", "s") for i in range(300)] + [(7, "again seven", "en", "s"), (8, LONG, "en", "s"), (None, "no key", "en", "s")])
    files = T.write(docs, shared_path(llm, "tokens-test", f"keyed-{id(docs)}"), BPE, end_id=2, shard_ids=200)
    got = T.fetch(files, [7, 8, None, 5000, 7]).collect()
    texts = sorted(LIBRARY.decode(T.unpack(r.ids, r.width).tolist()[:-1]) for r in got)
    assert texts == sorted(["text number 7", "again seven", "text number 8", LONG, "no key"])
    assert T.fetch(files, [5000]).count() == 0
    assert T.locate(files, llm.range(1000, 4000).select(F.col("id").alias("key"), F.lit(0).alias("ordinal"))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    r = random.Random(n)
    h1, h2 = (np.array([r.getrandbits(64) for _ in range(n)], np.uint64) for _ in range(2))
    levels, slots = T.perfect_hash(h1, h2)
    assert sorted(slots) == list(range(n))
    assert (T.slots_of(levels, h1, h2) == slots).all()
    assert sum(len(b) for b in levels) < 5 * n + 64 * 8


def test_same_hash_is_an_error():
    same = np.array([3, 3], np.uint64)
    with pytest.raises(ValueError):
        T.perfect_hash(same, same)


def test_empty_table(llm):
    files = T.write(doc_rows(llm, []), shared_path(llm, "tokens-test", "empty"), BPE, end_id=2)
    assert T.scan(files).count() == 0
    assert T.fetch(files, [1]).count() == 0
