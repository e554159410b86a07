import corpus_pipeline
from axonframe.llm import secrets
from axonframe.llm.quality import fit, statistics
from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_jaccard import brute as near_groups

import pyarrow as pa

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have = rows(docs)
    good = corpus_pipeline.quality_filter(spark, docs, SF)
    assert good.columns == COLUMNS
    kept = rows(good)
    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.score(statistics(pa.array([r.text or "" for r in have.values()])))
    assert kept == {d: r for (d, r), s in zip(have.items(), scores) if s >= 0.5}

    exact = corpus_pipeline.exact_dedup(spark, good, SF)
    assert exact.columns == COLUMNS
    last = {}
    for d, r in sorted(kept.items()):
        last[r.text or ""] = d
    unique = rows(exact)
    assert unique == {d: kept[d] for d in last.values()}

    near = corpus_pipeline.near_dedup(spark, exact, SF)
    assert near.columns == COLUMNS
    groups = near_groups([(d, r.text) for d, r in unique.items()])
    single = rows(near)
    assert sorted(map(repr, single)) == sorted(repr(d) for d, c in groups if d == c)

    clean = corpus_pipeline.redact_secrets(spark, near, SF)
    assert clean.columns == COLUMNS
    after = rows(clean)
    assert after.keys() == single.keys()
    for d, r in after.items():
        assert sum(secret_spans(r.text)[:3]) == 0 or not r.text
        if not secrets.all_spans(single[d].text or "", secrets.Novelty())[1]:
            assert r.text == single[d].text
        assert r.n_chars == (len(r.text) if r.text is not None else None)

    packed = corpus_pipeline.pack(spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == set(after)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_awkward_rows_pass_the_stages(spark):
    from tests.llm.cases import awkward, empty

    from axonframe.llm import chunk_dedup, quality, simhash

    labels = spark.createDataFrame([(5, 1), (-4, 0), (9, 1)], "doc_id long, quality int")
    docs = awkward(spark)
    for step in (lambda d: quality.keep_good(d, labels), chunk_dedup.drop_duplicates, simhash.keep_one, secrets.redact):
        out = step(docs)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        assert step(empty(spark)).count() == 0
    ids = sorted(map(repr, (r.doc_id for r in chunk_dedup.drop_duplicates(docs).collect())))
    assert ids == sorted(map(repr, [3, 3, None, 7, 9, 9, 11, -4, 12, 13]))
    assert {r.doc_id for r in secrets.redact(docs).where("text LIKE '%[SECRET]%'").collect()} == {None}
