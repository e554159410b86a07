import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from axonframe.llm import simhash
from axonframe.llm.common import shared_dir, with_groups
from axonframe.llm.components import components
from tests.llm.cases import awkward, empty


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((repr(d), f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark):
    for docs in (awkward(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = simhash.near_duplicates(docs).collect()
        assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute(rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(3)
    for near in range(5):
        a = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
        b = a.copy()
        for i in range(len(a)):
            for bit in rng.choice(64, near, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        ka, ra = simhash.keys_of(a.view(np.int64))
        kb, rb = simhash.keys_of(b.view(np.int64))
        seen = set(zip(ka.tolist(), ra.tolist()))
        met = {r for k, r in zip(kb.tolist(), rb.tolist()) if (k, r) in seen}
        assert len(met) == len(a)


def test_verification_in_parts(monkeypatch):
    """However the ordered keys fall into batches and steps, the links are those of all keys at once."""
    rng = np.random.default_rng(9)
    keys = np.sort(rng.integers(0, 40, 4000))
    fps = rng.integers(0, 1 << 7, 4000).astype(np.int64)
    whole = {tuple(p) for p in simhash.bucket_links(keys, fps).tolist()}
    monkeypatch.setattr(simhash, "VERIFY_ROWS", 150)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 70]), pa.array(fps[i : i + 70])], ["key", "fp"]) for i in range(0, 4000, 70)]
    got = {p for b in simhash._verify(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))}
    assert got == whole
    assert not list(simhash._verify(iter([])))


def test_hot_groups_are_spread(spark):
    """A group of a third of all rows, and groups of one, get the same answer as a plain join."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 10).alias("k"))
    groups = rows.groupBy(F.col("k").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("g <> 10")
    got = {tuple(r) for r in with_groups(rows, groups, {"k": "g"}, "n", 3000, "doc_id").select("doc_id", "n", "least").collect()}
    assert got == {(i, 1000, 0) if i % 3 == 0 else (i, None, None) if i == 1 else (i, 1, i) for i in range(3000)}


def test_no_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_bucket_edges_connect_large_buckets():
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    fps = np.unique([centre ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 3), replace=False)) for _ in range(400)])
    edges = simhash.bucket_edges(fps)
    assert len(edges) == len(fps) - 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7), (None, 3)] + [(500, i) for i in range(200, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[i] == 100 for i in range(100, 104))
    assert all(got[i] == 200 for i in [*range(200, 230), 500])
    assert len(got) == 41 + 4 + 31
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_random_edges(spark, monkeypatch):
    import axonframe.llm.components as module

    def small(by_node, whole=module._stars):
        def run(batches):
            import axonframe.llm.components as inside

            inside.STAR_EDGES = 7
            return whole(by_node)(batches)

        return run

    monkeypatch.setattr(module, "_stars", small)
    rng = np.random.default_rng(5)
    chain = rng.permutation(300) - 150
    edges = [(int(a), int(b)) for a, b in zip(chain[1:], chain)] + [(1000, int(x)) for x in range(1001, 1400)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (200, 2))] + [(5, 5), (None, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    table = spark.createDataFrame(edges + edges[:50], "a long, b long").repartition(9)
    got = [tuple(r) for r in components(table).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in parent}
