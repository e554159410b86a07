import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from axonframe.llm import quality, toxicity
from tests.llm.cases import awkward, empty

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("module, label, folds, fold, threshold", [(quality, "quality", 3, 1, 0.5), (toxicity, "toxic", 4, 2, 0.3)])
def test_held_out_accuracy(spark, module, label, folds, fold, threshold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in module.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for d, r in got.items())
    truth = {r.doc_id: r[label] for r in labels.collect() if got[r.doc_id].held_out}
    right = np.mean([got[d].predicted == y for d, y in truth.items()])
    recall = np.mean([got[d].predicted for d, y in truth.items() if y == 1])
    wrong = np.mean([got[d].predicted for d, y in truth.items() if y == 0])
    assert right > 0.97 and recall > 0.88 and wrong < 0.03


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_documents(spark, module):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (3, 0, 0), (None, 1, 1), (9, None, None), (11, 1, 0), (-4, 0, 1), (12, 1, 0)], LABELS)
    rows = module.score_documents(docs, labels).collect()
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, (r.doc_id for r in docs.collect())))
    assert all(0 <= r.score <= 1 for r in rows)
    assert module.score_documents(empty(spark), labels).count() == 0
    none = module.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_labels_of_the_held_out_fold_do_not_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        hidden = quality.held_out(labels.doc_id, module.FOLDS, module.HELD_OUT_FOLD)
        turned = labels.where(~hidden).unionByName(labels.where(hidden).withColumn(label, 1 - labels[label]))
        a, b = ({r.doc_id: r.score for r in module.score_documents(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality.fit_trees(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_folding_and_exceptions():
    words = ["Stоpid!!", "1d10t,", "***M0R0N***", "r\u00e9e\u0302ou", "2024", "", "clown", "@sshole", "a$$", "a$$!", "$hit", "(!diot!)", "!!!wow", "sh!t", "$5", "ＩＤＩＯＴ", "id\u200biot", "\u202eidiot", "US$", "!", "@", "ﬁne"]
    folded = toxicity.fold(pa.array(words)).to_pylist()
    assert folded == ["stopid", "idiot", "moron", "r\u00e9\u00eaou", "2024", "", "clown", "asshole", "ass", "ass", "shit", "idiot", "wow", "shit", "5", "idiot", "idiot", "idiot", "uss", "", "", "fine"]
    lexicon = {"clown": 3.0, "idiot": 2.0, "idio*": 1.0, "stu*": 1.5}
    m = toxicity.measures(pa.array(["a clown fish here", "a clown here", "an 1d10t", "stupidity", "nothing", ""]), toxicity.automaton(lexicon, ["clown fish"]))
    assert np.allclose(m[:, 0], np.log1p([0, 3, 2, 1.5, 0, 0]))


def brute_measures(text, lexicon, exceptions):
    """Each folded word against each term, without an automaton."""
    words = [f for w in re.findall(r"[^\x20\x09-\x0D]+", text) if (f := toxicity.fold(pa.array([w]))[0].as_py())]
    safe = {k for phrase in exceptions for i in range(len(words) - 1) if f"{words[i]} {words[i + 1]}" == phrase for k in (i, i + 1)}
    total, terms = 0.0, set()
    for i, w in enumerate(words):
        own = [(v, t) for t, v in lexicon.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)]
        if own and i not in safe:
            total += max(own)[0]
            terms.add(max(own)[1])
    n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    return [np.log1p(total), total / np.sqrt(n + 10), 100 * total / (n + 10), np.log1p(len(terms))] if terms else [0.0] * 4


def test_measures_against_brute_force():
    rng = np.random.default_rng(2)
    vocabulary = ["idiot", "1d10t", "idiocy", "stupid", "stupidity", "clown", "clowns", "fish", "@ss", "ass", "asset", "the", "a", "of!", "--", "moron,", "M0RON"]
    lexicon = {"idiot": 2.0, "idio*": 1.0, "stup*": 1.5, "clown": 3.0, "ass": 2.5, "moron": 2.25}
    exceptions = ["clown fish", "stupid ass", "the idiot"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(300)]
    got = toxicity.measures(pa.array(texts), toxicity.automaton(lexicon, exceptions))
    assert np.allclose(got, [brute_measures(t, lexicon, exceptions) for t in texts])


def test_exceptions_are_learned_from_clean_rows(spark):
    rng = np.random.default_rng(3)
    filler = lambda: " ".join(f"w{n}" for n in rng.integers(0, 60, 12))
    rows = [(1.0, f"{filler()} you clown {filler()}") for _ in range(200)] + [(0.0, f"{filler()} clown fish {filler()}") for _ in range(60)] + [(0.0, filler()) for _ in range(600)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "y double, text string"))
    assert "clown" in lexicon.weights and "clown fish" in lexicon.exceptions and "you clown" not in lexicon.exceptions


def brute_lexicon(rows):
    """Terms and exception phrases with their log ratios and certainties, from plain counts."""
    fold = lambda text: [f or None for f in toxicity.fold(pa.array(text.split(), pa.string())).to_pylist()]
    split = [(y, fold(t)) for y, t in rows]
    toxic, clean = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)

    def weighed(documents):
        t, c = Counter(), Counter()
        for y, found in documents:
            (t if y else c).update(found)
        for term in t.keys() | c.keys():
            w = np.log((t[term] + 0.5) / (toxic + 1)) - np.log((c[term] + 0.5) / (clean + 1))
            yield term, t[term], c[term], w, w / np.sqrt(1 / (t[term] + 0.5) + 1 / (c[term] + 0.5))

    terms = weighed([(y, {x for w in words if w for x in (w, *(w[:k] + "*" for k in range(4, 9) if k < len(w)))}) for y, words in split])
    weights = {term: w for term, t, _, w, z in terms if t >= toxicity.MIN_DOCS and z >= toxicity.MIN_Z and w >= 1}
    holds = lambda w: any(w.startswith(t[:-1]) if t.endswith("*") else w == t for t in weights)
    pairs = [(y, {f"{a} {b}" for a, b in zip(words, words[1:]) if a and b and (holds(a) or holds(b))}) for y, words in split]
    return weights, {p for p, _, c, _, z in weighed(pairs) if c >= toxicity.MIN_DOCS and z <= -toxicity.MIN_Z}


def test_lexicon_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"word{n}" for n in range(30)] + ["M0RON!", "moronic", "moro", "clown", "clowns", "fish", "--"]
    likely = lambda y: np.array([1.0] * 30 + [4.0 * y + 0.1] * 3 + [9.0 * y + 0.1] * 2 + [0.2, 1.0])
    rows = []
    for i in range(500):
        y, share = float(i % 3 == 0), likely(i % 3 == 0)
        text = " ".join(rng.choice(words, rng.integers(0, 30), p=share / share.sum()))
        rows.append((y, text + (" clown fish" if not y and i % 7 < 2 else "")))
    table = spark.createDataFrame(rows, "y double, text string")
    got, (weights, exceptions) = toxicity.learn_lexicon(table, None, None), brute_lexicon(rows)
    assert weights and exceptions and got.weights.keys() == weights.keys() and set(got.exceptions) == exceptions
    assert np.allclose([got.weights[t] for t in weights], list(weights.values()))
    few = toxicity.learn_lexicon(table, 2, 0)
    assert len(few.weights) == 2 and few.weights.items() <= got.weights.items() and few.exceptions == []


def test_a_long_text_of_terms_and_exceptions_takes_linear_time():
    machine = toxicity.automaton({"clown": 3.0}, ["clown fish"])
    began = time.perf_counter()
    (m,) = toxicity.measures(pa.array(["clown fish a clown " * 200_000]), machine)
    assert time.perf_counter() - began < 20 and np.isclose(m[0], np.log1p(3.0 * 200_000))


def test_repeated_ids_do_not_swell_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i} good") for i in range(300)] + [(2, f"other {i} bad") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS)
    assert {r.score for r in quality.score_documents(docs, labels, most=2).collect()}
    assert {r.score for r in toxicity.score_documents(docs, labels, most=20).collect()}


def scalar_statistics(text):
    """The statistics one character and word at a time."""
    raw = text.encode()
    classes = [("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t"), ("newline", "\n\r\x0b\x0c"), ("stop", ".?"), ("comma", ",;:"), ("bang", "!"), ("bar", "|"), ("symbol", "#$%&*@^~"), ("bracket", "<>{}[]()/\\")]
    kind = lambda b: "high" if b > 127 else next((n for n, cs in classes if chr(b) in cs), "other_ascii")
    counts = {n: 0 for n in quality._CLASSES}
    for b in raw:
        counts[kind(b)] += 1
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, pairs = len(words), list(zip(words, words[1:]))
    per = lambda x, by: x / max(by, 1)
    return [
        np.log1p(len(raw)), np.log1p(n), per(len(raw), n), *(per(counts[c], len(raw)) for c in quality._CLASSES),
        per(len(set(words)), n), per(len(set(pairs)), n - 1), per(sum(a == b for a, b in pairs), n - 1),
        per(sum(len(w) > 12 for w in words), n), per(sum(65 <= w[0] <= 90 for w in words), n),
    ]


def test_statistics_and_trees_against_scalar_versions(spark):
    texts = [r.text or "" for r in awkward(spark).select("text").collect()] + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    x = quality.statistics(pa.array(texts))
    assert np.allclose(x, [scalar_statistics(t) for t in texts])
    model = quality.fit_trees(x, (x[:, 4] > np.median(x[:, 4])).astype(float), trees=12)

    def walk(row):
        margin = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            margin += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-min(max(margin, -30), 30)))

    assert np.allclose(model.score(x), [walk(r) for r in x])
