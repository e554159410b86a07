"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from axonframe.llm import importance
from tests.llm.cases import DOCS, awkward, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, orders=3, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(words) - k + 1))


def brute(docs, target, orders=3, buckets=10_000, min_words=20, percent=5, seed=42):
    made = [(i, *features(t, orders, buckets)) for i, t in docs]
    s, t = sum((c for *_, c in made), Counter()), sum((features(x, orders, buckets)[1] for x in target), Counter())
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for i, words, c in made:
        weight = sum(n * gain(b) for b, n in c.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([len(words) >= min_words, i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted((tuple(r[1:]) for r in rows), key=repr)


def got(docs, target, **options):
    return sorted(map(tuple, importance.resampled(docs, target, **options).collect()), key=repr)


def corpus(spark, n, seed=5):
    rng = random.Random(seed)
    words = [f"{'Üß'[i % 2]}w{i}" if i % 9 == 0 else f"W{i}" for i in range(80)]
    rows = [(rng.randrange(10 * n), " ".join(rng.choices(words, k=rng.randrange(60))) + rng.choice(["", ". ", "-x-"]), "en", "a", 0) for _ in range(n)]
    target = [(i, " ".join(rng.choices(words[:20], k=30)), ) for i in range(10)]
    return spark.createDataFrame(rows, DOCS).repartition(7), spark.createDataFrame(target, "item_id long, text string")


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_against_plain_python(spark):
    docs, target = corpus(spark, 400)
    asked = [r["text"] for r in target.collect()]
    want = brute(pairs(docs), asked)
    assert got(docs, target) == want and sum(r[-1] is not None for r in want) > 5
    options = {"orders": 2, "buckets": 50, "min_words": 5, "percent": 40, "seed": 1}
    assert got(docs, target, **options) == brute(pairs(docs), asked, **options)


def test_awkward_rows_and_empty_tables(spark):
    docs, (_, target) = awkward(spark), corpus(spark, 5)
    asked = [r["text"] for r in target.collect()]
    options = {"min_words": 1, "percent": 50}
    assert got(docs, target, **options) == brute(pairs(docs), asked, **options)
    assert importance.resampled(empty(spark), target).count() == 0
    none = target.limit(0)
    assert got(docs, none, **options) == brute(pairs(docs), [], **options)


def test_documents_drawn_lie_nearer_to_the_target(spark):
    docs, target = corpus(spark, 400)
    rows = importance.resampled(docs, target, percent=10).collect()
    drawn = [r["weight"] / r["n_features"] for r in rows if r["rank"]]
    rest = [r["weight"] / r["n_features"] for r in rows if not r["rank"] and r["n_features"]]
    assert sum(drawn) / len(drawn) > sum(rest) / len(rest)


def test_windows_need_no_shuffle_beyond_that_of_the_texts(spark):
    docs, _ = corpus(spark, 20)
    plan = importance.positions(importance._rows(docs, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(row") == 1 and "Window" in plan and "Python" not in plan
