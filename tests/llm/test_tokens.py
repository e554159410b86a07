import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from axonframe.llm import packing, token_orc
from axonframe.llm.common import encode_words
from tests.llm.cases import awkward, empty

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    return SimpleNamespace(path=path, encode=Tokenizer.from_file(path).encode)


def encoded(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], np.uint32)


@pytest.mark.parametrize("source", ["cases", "documents"])
def test_orc_round_trip(spark, tokenizer, source):
    docs = awkward(spark) if source == "cases" else spark.read.parquet(f"{SF}/documents.parquet")
    got = token_orc.encode_to_orc(docs).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect()))
    start, want = 0, []
    for there, doc_id, text in rows:
        ids = encoded(tokenizer, text, 1)
        want.append((doc_id if there else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


#: Special tokens in each case, letters that lower-casing or normalising takes apart, marks, spaces and signs of all kinds.
PARTS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "|>", "<|", "İ", "İ!", "ß.", "ſ,", "\u0958", "\ufb2a", "e\u0301", "\u00e9", "\u0301", "\u0338", ">", "=", "a", "Hello", "WORLD", "'s", "'S", "'re", "don't", "2024", "1", "x²", "½", "ǅ", "\u00a0", "\u2003", "\u200b", " ", "\n", "\t", "\x85", "\x1c", "你好", "🙂🙂", "...", "!!", "$", "_", "ΟΔΟΣ", "ς", "A\u030a", "\u212b", "\u037e", "ﷺ", "\u1100\u1161", "가", "ŉ"]


@given(st.lists(st.tuples(st.sampled_from(PARTS) | st.text(max_size=4), st.sampled_from(["", " "])), max_size=25))
@settings(max_examples=400, deadline=None)
def test_words_encode_as_whole_texts(tokenizer, parts):
    text = "".join(a + b for a, b in parts)
    ids, first = encode_words(pa.array([text, "x"], pa.string()), tokenizer.path)
    assert ids[: first[1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_match_in_their_own_case(spark):
    docs = spark.createDataFrame([(1, "x <|ENDOFTEXT|> y")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in token_orc.encode_to_orc(docs).collect()] == [(9, 2295511120)]
    assert [r.length for r in packing.pack_documents(docs).collect()] == [9]


def test_orc_empty(spark):
    assert token_orc.encode_to_orc(empty(spark)).count() == 0


@pytest.mark.parametrize("source", ["cases", "documents"])
def test_packing(spark, tokenizer, source):
    docs = awkward(spark) if source == "cases" else spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack_documents(docs, group_pieces=40).collect()
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = encoded(tokenizer, r.text, 0)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    have, places = defaultdict(int), defaultdict(list)
    for r in got:
        have[tuple(r)[:5]] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {(r.n_sequences, r.least_sequences) for r in got} == {(len(places), packing.lower_bound(np.array([r.length for r in got]), 2048))}
    assert len(places) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + 2


@pytest.mark.parametrize("group_pieces", [packing.GROUP_PIECES, 300])
def test_packing_meets_its_bound(spark, group_pieces):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, group_pieces=group_pieces)
    r = got.agg(F.countDistinct("sequence_id").alias("n"), F.max("n_sequences").alias("said"), F.max("least_sequences").alias("least"), F.max(F.col("offset") + F.col("length")).alias("fill"), F.count(F.lit(1)).alias("rows")).first()
    assert r.n == r.said <= r.least + 1 and r.fill <= 2048
    assert got.select("doc_id", "piece").distinct().count() == r.rows


def test_exchange_rounds_against_one_round(spark):
    """Groups of a few pieces each waste a sequence apiece; the rounds mend that, and their sequences stay whole."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i if i % 9 else None, "w " * int(n)) for i, n in enumerate(rng.integers(0, 160, 600))], "doc_id long, text string")
    once, often = (packing.pack_documents(docs, capacity=200, group_pieces=20, rounds=n).collect() for n in (1, None))
    counts = [len({r.sequence_id for r in rows}) for rows in (once, often)]
    assert counts[1] < counts[0] and often[0].least_sequences <= counts[1] == often[0].n_sequences
    for rows in (once, often):
        assert len(rows) == 600
        ends = defaultdict(list)
        for r in rows:
            ends[r.sequence_id].append((r.offset, r.offset + r.length))
        for parts in ends.values():
            parts.sort()
            assert parts[0][0] == 0 and parts[-1][1] <= 200 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_packing_empty(spark):
    assert packing.pack_documents(empty(spark)).count() == 0


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, _ = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
