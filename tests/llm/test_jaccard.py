import re

import numpy as np
import pyarrow as pa

from axonframe.llm import jaccard, simhash
from tests.llm.cases import awkward, empty


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least.get(root(i))) for i, (d, _) in enumerate(rows)]


def test_similar_documents(spark):
    for docs in (awkward(spark), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = [(r.doc_id, r.component_id) for r in jaccard.similar_documents(docs).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert jaccard.similar_documents(empty(spark)).count() == 0


def test_keep_one_goes_by_similarity(spark):
    """Pairs on either side of 0.8: 5 to 13 bits apart above it, both of which the 4-bit links keep, and pairs below it."""
    rng = np.random.default_rng(11)
    rows, drop = [], set()
    for k in range(60):
        words = [f"w{n}" for n in rng.integers(0, 5000, 200)]
        other = list(words)
        for at in rng.choice(200, int(rng.integers(1, 14)), replace=False):
            other[at] = f"x{k}y{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        drop |= {2 * k + 1} if len(a & b) >= 0.8 * len(a | b) else set()
    assert 5 < len(drop) < 55
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d, _ in rows} - drop


def test_bands_meet():
    """Pairs of similarity just above 0.8 agree in a band."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(3000):
        x = rng.integers(0, 1 << 62, 110).astype(np.uint64)
        sets += [x[:99], x[11:]]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bands = jaccard.bands_of(np.concatenate(sets), first)
    assert (bands[::2] == bands[1::2]).any(axis=1).all()


def test_star_edges_are_the_links_of_the_hub():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([np.arange(100), rng.integers(100, 160, int(rng.integers(1, 60)))])).astype(np.uint64) for _ in range(40)] + [np.array([7], np.uint64), np.arange(1000, 1040, dtype=np.uint64)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for hub in (0, 17, 40, 41):
        mine = set(sets[hub].tolist())
        want = [i for i, s in enumerate(sets) if i != hub and len(mine & set(s.tolist())) >= 0.8 * len(mine | set(s.tolist()))]
        assert jaccard.star_edges(np.concatenate(sets), first, hub).tolist() == want


def test_a_bucket_of_long_texts_is_split_by_its_bytes(spark, monkeypatch):
    """Long texts that share a passage of 0.6 of their shingles, and two near copies among them: many blocks, the same result."""
    rng = np.random.default_rng(9)
    shared = [f"s{n}" for n in range(1200)]
    rows = [(i, " ".join([*shared, *(f"w{i}x{n}" for n in range(300 + 10 * (i % 3)))])) for i in range(30)]
    rows += [(100, rows[7][1] + " one more"), (101, rows[8][1] + " two more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(repr, brute(rows)))
    monkeypatch.setattr(jaccard, "ENTRIES", 5000)
    assert sorted(map(repr, map(tuple, jaccard.similar_documents(docs).collect()))) == want


def test_pairs_at_half_similarity_do_not_chain(spark):
    """Each text shares half of its shingles with the next one: candidates in a row, and no link."""
    words = [f"w{n}" for n in range(4000)]
    rows = [(i, " ".join(words[30 * i : 30 * i + 94])) for i in range(120)]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(120)]


def test_sets_of_sliced_texts():
    texts = pa.array(["", "a b", "A b", "a b c d e f g a b c d e", None, "x"]).fill_null("")
    hashes, first = jaccard.sets_of(texts)
    assert np.diff(first).tolist() == [1, 1, 1, 7, 1, 1]
    node = jaccard.names_of(hashes, first)[0]
    assert not np.array_equal(*jaccard.names_of(hashes, first))
    assert node[1] == node[2] and node[0] == node[4] and len(set(node.tolist())) == 4
    again, first = jaccard.sets_of(texts.slice(3))
    assert jaccard.names_of(again, first)[0].tolist() == node[3:].tolist()


def test_large_groups_are_verified_in_blocks(spark):
    """One group of near copies, chains and sets on both sides of 0.8, in blocks of 8 and in one block: what brute force finds."""
    rng = np.random.default_rng(6)
    base = [f"b{n}" for n in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    for i in range(40):
        rows.append((200 + i, " ".join(base[3 * i % 60 :] + [f"c{k}" for k in range(3 * i % 60)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(map(repr, brute(rows)))
    assert 5 < len({c for _, c in brute(rows)}) < 190
    for block in (8, jaccard.BLOCK):
        assert sorted(map(repr, (tuple(r) for r in jaccard.similar_documents(docs, block=block).select("doc_id", "component_id").collect()))) == want


def test_cross_edges_join_roots_once():
    sets = [np.arange(0, 40), np.arange(1, 41), np.arange(2, 42), np.arange(500, 540)]
    first = np.arange(0, 161, 40)
    root = np.array([0, 1, 1, 3])
    assert jaccard.cross_edges(np.concatenate(sets).astype(np.uint64), first, root, np.array([True, False, False, True])) == [(0, 1)]


def test_fingerprint_keys_name_candidates(spark, monkeypatch):
    """Without any band, the pairs that Golay-code keys connect and that are similar are linked, and no others; the pipeline's stage asks for these keys."""
    import corpus_pipeline

    rng = np.random.default_rng(21)
    rows = []
    for k in range(40):
        words = [f"w{n}" for n in rng.integers(0, 5000, 900)]
        rows.append((3 * k, " ".join(words)))
        for copy in (1, 2):
            for at in rng.choice(900, int(rng.integers(1, 25)), replace=False):
                words[at] = f"x{k}y{copy}z{at}"
            rows.append((3 * k + copy, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    fps = jaccard.majorities(*jaccard.sets_of(pa.array([t for _, t in rows])))
    kin, own = list(range(len(rows))), list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    for names, linked in ((kin, lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 4), (own, lambda i, j: kin[i] == kin[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))):
        for i, j in pairs:
            if linked(i, j):
                low, high = sorted((names[i], names[j]))
                names[:] = [low if x == high else x for x in names]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs, bands=0).collect()}
    assert got == dict(enumerate(own)) and 40 < len(set(own)) < 110
    asked, links = [], jaccard.fingerprint_links
    monkeypatch.setattr(jaccard, "fingerprint_links", lambda fps: asked.append(fps.count()) or links(fps))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert asked == [len(set(fps.tolist()))] and kept == {d for d, c in brute(rows) if d == c}
