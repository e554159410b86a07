"""Fill-in-the-middle against plain Python, and exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axonframe.llm import fim
from tests.llm.cases import DOCS, awkward, empty


def brute(doc_id, text, seed=7, rate=100, spm_rate=50, marks=fim.SENTINELS):
    p, s, m = marks
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(pre), len(mid), s + suf + p + pre + m + mid) if h[3] % 100 < spm_rate else (len(units), "psm", len(pre), len(mid), p + pre + s + suf + m + mid)


def expected(rows, **options):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(((i, *(made := brute(i, t or "", **options))[:4], sha(made[4]), sha(t or "")) for i, t in rows), key=repr)


def test_against_plain_python(spark):
    df = awkward(spark)
    more = [(1000 + i, "\n" * (i % 3) + "line\n" * (i % 7) + "tail" * (i % 2) + ("<S" if i % 5 == 0 else "") + ("<M>" if i % 11 == 0 else ""), "en", "a", 0) for i in range(200)]
    df = df.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, DOCS))
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, fim.digest(df).collect()), key=repr) == expected(rows)
    options = {"seed": 3, "rate": 60, "spm_rate": 20}
    assert sorted(map(tuple, fim.digest(df, **options).collect()), key=repr) == expected(rows, **options)
    assert {r["form"] for r in fim.digest(df).collect()} == {"plain", "spm", "psm"}


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="a<>PSM\n\r é🙂", max_size=30), min_size=1, max_size=20))
def test_round_trip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fim.with_forms(df).select("doc_id", "text", "form", "output", fim.restored(F.col("output"), F.col("form")).alias("back"))
    for r in made.collect():
        assert r["back"] == r["text"] == texts[r["doc_id"]] and r["output"] == brute(r["doc_id"], r["text"])[4]


def test_other_columns_stay_and_names_clash(spark):
    df = awkward(spark).withColumns({"fim_form": F.lit("clash"), "units": F.lit("clash"), "output": F.lit("clash"), "row": F.lit("clash")})
    out = fim.fill_in_middle(df)
    assert out.columns == [*df.columns, "fim_form_0"] and out.where("fim_form <> 'clash' OR units <> 'clash' OR row <> 'clash'").count() == 0
    want = sorted(brute(r["doc_id"], r["text"] or "")[4] for r in df.select("doc_id", "text").collect())
    assert sorted(r["text"] for r in out.select("text").collect()) == want
    assert fim.fill_in_middle(empty(spark)).count() == 0 and fim.digest(empty(spark)).count() == 0


def test_sentinels_have_to_be_told_apart():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("<P>", "<<P>>", "<M>")):
        with pytest.raises(ValueError):
            fim._check(marks)


def test_plan_has_neither_python_nor_shuffle(spark):
    plan = fim.digest(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
