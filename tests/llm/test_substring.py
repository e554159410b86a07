import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axonframe.llm import substring
from axonframe.llm.common import with_groups
from tests.llm.cases import DOCS, awkward, empty


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((repr(doc_id), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(docs, window=35, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = substring.removal_digest(docs, window=window, **options).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, window)


def test_cases(spark):
    check(awkward(spark))
    assert substring.removal_digest(empty(spark)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    check(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").repartition(5))


@pytest.mark.parametrize("frequent", [2, 256])
def test_shared_passages(spark, frequent):
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(400)}"
    shared = [[word() for _ in range(rng.randrange(8, 70))] for _ in range(6)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [word() for _ in range(rng.randrange(0, 60))] + shared[rng.randrange(6)] * rng.choice([0, 1, 1, 2])
        rows.append((i, (" " if i % 2 else " \n ").join(words), None, None, None))
    rows += [(400, "der " * 90 + "und " * 40, None, None, None), (401, "der " * 50, None, None, None), (402, "solo " * 35, None, None, None)]
    check(spark.createDataFrame(rows, DOCS).repartition(6), frequent=frequent)
    check(spark.createDataFrame(rows, DOCS).repartition(6), window=12, frequent=frequent, prefix=4)


@pytest.mark.parametrize("frequent", [50, 4096])
def test_many_repeated_rows(spark, frequent):
    """10,000 rows of one id and text, 3,000 others that share a passage, and one long text of a single word."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(7, passage + " tail " * 3)] * 10_000 + [(100 + i, f"a{i} b{i} {passage} c{i}") for i in range(3000)] + [(9, "und " * 60_000), (None, passage), (None, passage)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), frequent=frequent)


def test_a_passage_of_every_document_has_no_hot_task(spark):
    """The counts of a prefix that 4,000 documents share are broadcast, and its rows stay spread over the partitions."""
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {passage} " + " ".join(f"c{i % 50}x{k}" for k in range(36))) for i in range(4000)], "doc_id long, text string").repartition(7)
    check(docs, frequent=100)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(8000).select(F.when(F.col("id") % 5 > 0, 1).otherwise(F.col("id")).alias("h"), F.col("id").alias("key"))
    counts = rows.groupBy(F.col("h").alias("prefix")).agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = with_groups(rows, counts, {"h": "prefix"}, "n", 8000, "key")
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) == n and max(sizes) <= 2 * sum(sizes) / n and joined.where("prefix IS NULL").count() == 0


def test_long_runs_are_packed_in_pieces(monkeypatch):
    monkeypatch.setattr(substring, "RUN_WINDOWS", 10)
    row, runs = substring.pack_runs(np.array([5, 100]), np.array([25, 3]))
    assert row.tolist() == [0, 0, 0, 1]
    assert [(int(r) >> 24, int(r) & 0xFFFFFF) for r in runs] == [(5, 10), (15, 10), (25, 5), (100, 3)]
    big = substring.pack_runs(np.array([1 << 36]), np.array([3]))[1]
    assert big[0] >> 24 == 1 << 36


def test_words_decide_and_not_hashes():
    code = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    assert substring.alike(code, np.array([0, 0, 0]), np.array([3, 6, 3]), np.array([3, 3, 2])).tolist() == [False, True, True]


def frames(texts):
    import zstandard

    squeeze = zstandard.ZstdCompressor().compress
    n = len(texts)
    found = [np.unique(substring.Anchors(pa.array([t]), 5, 2).hash) for t in texts]
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32), pa.array(np.concatenate(found)))
    none = pa.array([[]] * n, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([squeeze(t.encode()) for t in texts], pa.binary()), lists, none], ["doc_id", "mark", "frame", "prefixes", "frequent"])


@pytest.mark.parametrize("remembered, slice_bytes", [(0, 40), (100, 40), (1 << 20, 40), (1 << 20, 1 << 20)])
def test_what_a_task_remembers_changes_nothing(monkeypatch, remembered, slice_bytes):
    """Stretches are merged within a slice, with what the task remembers, or in the trees: the runs are the same."""
    monkeypatch.setattr(substring, "REMEMBERED_BYTES", remembered)
    monkeypatch.setattr(substring, "ONE_SLICE", slice_bytes)
    texts = ["a b c d e f g", "x a b c d e y", "q w e r t z u", "a b c d e f g", "q w e r t y"] * 2 + ["only once here it stands"]
    rows = pa.Table.from_batches(substring._stretches(5, 2)(iter([frames(texts)]))).sort_by("g").to_batches(max_chunksize=3)
    covered = set()
    for b in substring._trees(5)(iter(rows)):
        for d, run in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            covered |= {(d, (run >> 24) + k) for k in range(run & 0xFFFFFF)}
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 5]) for w in split for i in range(len(w) - 4))
    assert covered == {(d, i) for d, w in enumerate(split) for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1}
