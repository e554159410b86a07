import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from axonframe.llm import sentencepiece_codec
from tests.llm.cases import awkward, empty


def test_equals_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for docs in (awkward(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = sentencepiece_codec.round_trip(docs, giant=3000, chunk=500).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.array(model.encode(r.text or ""), np.uint32)
            want.append((repr(r.doc_id), len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted((repr(r.doc_id), *r[1:]) for r in got) == sorted(want)
        decoded = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_documents(docs, giant=3000, chunk=500)).collect()
        assert sorted((repr(r.doc_id), r.ids, r.text) for r in decoded) == sorted((repr(r.doc_id), model.encode(r.text or ""), r.text or "") for r in docs.select("doc_id", "text").collect())
    assert sentencepiece_codec.round_trip(empty(spark)).count() == 0


def test_cuts_are_safe():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    whole, rest = sentencepiece_codec.processors(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "▁", "x1", "hello", " the"]) for _ in range(200))
        parts = sentencepiece_codec.cut(text, 40)
        assert "".join(parts) == text
        ids = [i for k, p in enumerate(parts) for i in (rest if k else whole).encode(p)]
        assert ids == model.encode(text)
