"""Quality rules against plain Python, on awkward and random rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from axonframe.llm import line_rules
from tests.llm.cases import DOCS, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least, share, depleted):
    """(id, host, text) rows -> expected tuples."""
    texts_of, lines_of = defaultdict(set), defaultdict(set)
    normal = lambda line: " ".join(WORD.findall(line.translate({c: c + 32 for c in range(65, 91)})))
    for _, host, text in rows:
        texts_of[host].add(text)
        for line in text.split("\n"):
            if normal(line):
                lines_of[host, normal(line)].add(text)
    often = {k for k, t in lines_of.items() if len(t) > least and len(t) > share * len(texts_of[k[0]])}
    out = []
    for doc_id, host, text in rows:
        words, lines = WORD.findall(text), [x for x in text.split("\n") if normal(x)]
        five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if five[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        gone = sum(len(WORD.findall(x)) for x in lines if (host, normal(x)) in often)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and gone <= depleted * len(words), gone))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(map(tuple, line_rules.quality_rules(df, **options).collect()), key=repr)


def random_docs(n, seed):
    rng = random.Random(seed)
    common = [" ".join(rng.choices("alpha beta gamma delta épsilon 你好 # x".split(), k=rng.randrange(1, 9))) for _ in range(12)]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))]
        lines = [rng.choice([s, s.upper(), f"  {s}\t", s.replace(" ", "  ")]) for s in lines]
        rows.append((i, f"h{rng.randrange(3)}", "\n".join(lines)))
    return rows + rows[:15]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", h, 0) for i, h, t in rows], DOCS)


@pytest.mark.parametrize("seed, least, share", [(1, 3, 0.05), (2, 0, 0.15), (3, 10, 0.02)])
def test_against_plain_python(spark, seed, least, share):
    rows = random_docs(150, seed)
    want = brute(rows, least, share, 0.5)
    assert got(frame(spark, rows).repartition(5), least=least, share=share) == want
    assert any(r[-1] for r in want)


def test_awkward_and_empty(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["source"] or "", r["text"] or "") for r in df.select("doc_id", "source", "text").collect()]
    assert got(df) == brute(rows, line_rules.LEAST, line_rules.SHARE, line_rules.DEPLETED)
    assert line_rules.quality_rules(empty(spark)).count() == 0


def test_copies_of_a_document_count_once(spark):
    text = "one line of the copied text that has enough words here\nand a second one with a few more"
    rows = [(i, "h", text) for i in range(40)] + [(100 + i, "h", f"page {i}\nshared footer with quite a few words in it, more than the page has") for i in range(20)]
    kept = {r["doc_id"]: r["kept"] for r in line_rules.quality_rules(frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(20))


def test_hosts_do_not_share_their_counts(spark):
    rows = [(i, f"h{i}", f"page number {i} with some words of its own to stand on\nthe same footer everywhere") for i in range(40)]
    assert all(r["kept"] and not r["n_removed"] for r in line_rules.quality_rules(frame(spark, rows)).collect())


def test_cleaned_documents_lose_lines_above_limits(spark):
    rows = [(i, "h", f"Page {i} has words of its own, eleven of them or more\n\nShared  FOOTER line\nlast {i}") for i in range(30)] + [(99, "h", "shared footer line")]
    out = {r["doc_id"]: r["text"] for r in line_rules.cleaned_documents(frame(spark, rows)).collect()}
    assert out == {i: f"Page {i} has words of its own, eleven of them or more\n\nlast {i}" for i in range(30)}
    assert line_rules.cleaned_documents(empty(spark)).count() == 0


def test_repeat_words_of_short_texts():
    assert line_rules.repeat_words(np.empty(0, np.int64), np.array([0, 0])).tolist() == [0]
    code = np.array([1, 1, 1, 1, 1, 1, 2, 2])  # five equal windows cannot reach over the end of a text
    assert line_rules.repeat_words(code, np.array([0, 6, 8])).tolist() == [6, 0]
