import math

import numpy as np
import pyarrow.parquet as pq

from axonframe.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, id long"


def brute(rows, cosine=0.98):
    ok = [l is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    n, links, root = len(rows), np.zeros(len(rows), int), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    groups = {}
    for i in range(n):
        if ok[i]:
            groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for own in groups.values():
        x = np.array([rows[i][1] for i in own], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        for i, j in zip(a, b):
            links[own[i]] += 1
            links[own[j]] += 1
            root[find(own[i])] = find(own[j])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(repr(r[0]), int(links[i]), least.get(find(i)) if ok[i] else r[0]) for i, r in enumerate(rows)]


def result(df, **options):
    return [(repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicate_vectors(df, **options).collect()]


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    base = [float(x) for x in rng.normal(size=8)]
    close = [x + 1e-3 for x in base]
    rows = [(1, base, 1), (2, base, 1), (3, close, 1), (4, base, 2), (5, None, 1), (6, [], 1), (7, [0.0] * 8, 1), (8, [None] + base[1:], 1), (9, [float("nan")] + base[1:], 1), (10, [float("inf")] + base[1:], 1), (11, base, None), (None, close, 1), (3, close, 1), (12, base[:4], 1), (13, [2 * x for x in base], 1), (14, [-x for x in base], 1), (15, [1e-30 * x for x in base], 3), (16, [1e30 * x for x in base], 3)]
    df = spark.createDataFrame([(i, v, l, "clash", 0) for i, v, l in rows], SCHEMA)
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = result(df)
    assert sorted(got, key=repr) == sorted(((i, n, c, i == repr(c)) for i, n, c in brute(stored)), key=repr)
    assert hnsw.near_duplicate_vectors(df.limit(0)).count() == 0


def test_recall_over_shards(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()]
    rng = np.random.default_rng(4)
    near = rng.normal(size=64)
    rows += [(10_000 + i, [float(x) for x in near + rng.normal(size=64) * 0.02], 1) for i in range(150)]
    df = spark.createDataFrame([(i, v, l, "x", 0) for i, v, l in rows], SCHEMA)
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = {i: (n, c) for i, n, c in brute(stored)}
    for least, options in ((0.97, {"shard": 40}), (1, {"shard": 40, "exact": True})):
        got = {i: (n, c) for i, n, c, _ in result(df, **options)}
        assert got.keys() == want.keys()
        assert sum(n for n, _ in got.values()) >= least * sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in got)
        assert sum(got[i][1] == want[i][1] for i in got) >= least * len(got)


def test_recall_over_large_shards(spark):
    """Three shards of about 1,200 vectors, rare links beside a group of hundreds: the graphs find them, and are what finds them."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3300, 32))
    x[1:900:3] = x[0:900:3] + rng.normal(size=(300, 32)) * 0.05
    x[2900:] = rng.normal(size=32) + rng.normal(size=(400, 32)) * 0.06
    df = spark.createDataFrame([(i, v.tolist(), 1, "x", 0) for i, v in enumerate(x)], SCHEMA)
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = {i: (n, c) for i, n, c in brute(stored)}
    got = {i: (n, c) for i, n, c, _ in result(df, shard=1200)}
    assert sum(n for n, _ in want.values()) > 50_000
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(got)


def test_each_pair_of_shards_meets_once():
    """Each graph is shipped once, each pair of shards compared once, and no graph has far more than half the others to search."""
    met = []
    for i in range(9):
        mine = [j for j in range(9) if j != i and (min(i, j) if abs(i - j) % 2 else max(i, j)) == i]
        assert len(mine) == 4
        met += [frozenset((i, j)) for j in mine]
    assert len(set(met)) == len(met) == 36


def test_audit_leaves_out_a_vector_itself():
    x = np.eye(50)
    rows, truth = hnsw.audited(x, x, 0.98, True)
    assert len(rows) == 50 and not truth.any()


def test_graph_search_finds_neighbours():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graphs = hnsw.build(x)
    assert [len(g) for g in graphs] == [12, 188, 3000]
    found, _ = hnsw.search(x, graphs[-1], x[:200], hnsw.descend(x, graphs[:-1], x[:200], len(x)), 64)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(f) & set(t)) / 10 for f, t in zip(found, truth)]) > 0.8


def test_links_of_dense_groups(monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * rng.choice([0.05, 0.3, 2.0], (3000, 1))
    near, exact = hnsw._unit(x)
    monkeypatch.setattr(hnsw, "plain_links", None)
    q, p = hnsw.links(near, hnsw.build(near), near, exact, exact, 0.98, True)
    truth = exact @ exact.T >= 0.98
    assert truth[q, p].all() and len(set(zip(q.tolist(), p.tolist()))) == len(q)
    assert len(q) >= 0.995 * truth.sum()


def test_plain_comparison_is_the_last_resort():
    """A graph without links finds nothing but the entry point; the audit sees it, and no link is lost."""
    rng = np.random.default_rng(3)
    near, exact = hnsw._unit(np.repeat(rng.normal(size=(300, 8)), 3, axis=0) + rng.normal(size=(900, 8)) * 0.01)
    q, p = hnsw.links(near, [np.full((900, hnsw.LINKS), -1, np.int32)], near, exact, exact, 0.98, True)
    assert len(q) == (exact @ exact.T >= 0.98).sum()
