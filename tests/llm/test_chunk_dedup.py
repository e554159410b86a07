import hashlib
from collections import Counter

from pyspark.sql import functions as F

from axonframe.llm import chunk_dedup
from tests.llm.cases import awkward, empty


def expected(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    out = []
    for doc_id, text in rows:
        ids = [d for d, t in rows if t == text]
        top = max((d for d in ids if d is not None), default=None)
        out.append((doc_id, top, len(ids), doc_id == top, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def test_exact_duplicates(spark):
    docs = awkward(spark)
    got = chunk_dedup.exact_duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == expected(docs)
    assert chunk_dedup.exact_duplicates(empty(spark)).count() == 0


def test_chunks_join_to_the_text_and_resynchronise(spark):
    text = " ".join(f"word{i * i * 7919 % 99991}" for i in range(5000))
    df = spark.createDataFrame([(text,), ("inserted at the front " + text,), ("é" * 3000,)], "text string")
    rows = df.select(F.col("text"), chunk_dedup.chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert "".join(r.c).encode("latin-1").decode() == r.text
    assert len(set(rows[0].c) & set(rows[1].c)) > 0.5 * len(rows[0].c)


def test_identifier_that_collides_is_replaced(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    weak, strong = (lambda c: F.length(c)), (lambda c: F.sha2(c, 256))
    assert chunk_dedup.verified_identifier(df, [weak, strong]) is strong
