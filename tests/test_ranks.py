"""Ranks, quantiles, densities and current ids against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import nuclei, ranks, training, versions


def test_ranks_within_hot_and_null_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, v int, i int").repartition(5).withColumns({c: F.lit("clash") for c in ("of", "place", "part", "at")})
    got = {r["i"]: (r["rank"], r["size"]) for r in ranks.ranked(df, "k", F.col("v").desc_nulls_last(), F.asc("i")).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: (n, len(mine)) for n, r in enumerate(mine, 1)}
    assert got == want
    assert ranks.ranked(df.limit(0), "k", F.asc("v")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 997])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 5.0, 5.0, rng.gauss(0, 9)]), rng.gauss(2, 1), None) for _ in range(n)]
    rows[0] = (1.5, 2.5, None)
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    at = [0, 0.05, 0.25, 0.5, 0.9, 1]
    got = ranks.quantiles(df, ["a", "b", "c"], at).first()
    for i, c in enumerate("ab"):
        assert np.allclose(got[c], np.quantile([r[i] for r in rows if r[i] is not None], at))
    assert got["c"] == [None] * len(at)
    assert ranks.quantiles(df.limit(0), ["a"], [0.5]).first()["a"] == [None]
    with pytest.raises(ValueError):
        ranks.quantiles(df, ["a"], [1.5])


def test_quantiles_gather_neither_a_column_nor_ties(spark):
    text = ranks.quantiles(spark.range(1000).select((F.col("id") % 3).cast("double").alias("v")), ["v"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in text and "collect_list" not in text


@pytest.mark.parametrize("width", [None, 3.0, 25.0])
def test_density_equals_the_plain_sum(spark, width):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(-40, 20, 800), rng.uniform(-250, 90, 200), np.full(100, 12.0)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    got = sorted(map(tuple, training.kde(df, "v", points=101, width=width).collect()))
    inside = values[(values >= -200) & (values <= 50)]
    h = width or 0.9 * min(inside.std(ddof=1), np.subtract(*np.quantile(inside, [0.75, 0.25])) / 1.34) * len(inside) ** -0.2
    x = np.linspace(-200, 50, 101)
    want = np.exp(-0.5 * ((x[:, None] - inside) / h) ** 2).sum(axis=1) / (len(inside) * h * np.sqrt(2 * np.pi))
    assert np.allclose([g[0] for g in got], x) and np.abs(np.array([g[1] for g in got]) - want).max() < 1e-9


def test_density_of_few_values_and_bandwidth_rule(spark):
    one = spark.createDataFrame([(0.0,)], "v double")
    assert max(r["density"] for r in training.kde(one, "v", points=51).collect()) == pytest.approx(1 / (0.9 * np.sqrt(2 * np.pi)), rel=1e-9)
    assert [r["density"] for r in training.kde(one.limit(0), "v", points=3).collect()] == [None] * 3
    assert training.bandwidth(32, 2.0, 1.34) == pytest.approx(0.45) and training.bandwidth(32, 2.0, 0.0) == pytest.approx(0.9) and training.bandwidth(1, None, 0.0, -3.0) == pytest.approx(2.7)
    with pytest.raises(ValueError):
        training.kde(one, "v", width=1e-9)


def test_group_limit_comes_before_the_shuffle(spark):
    text = training.soft_negatives(spark.range(100).select((F.col("id") % 3).alias("root_id"), F.col("id").alias("l2_id")), 4)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_all_nuclei_need_no_window_by_root(spark):
    rows = [(i, "A", f"{i % 90},1,1", float(i % 7)) for i in range(300)] + [(900, "B", "1,1,1", None)]
    df = spark.createDataFrame(rows, "id int, pt_root_id string, pt_position string, volume double")
    out = nuclei.dedup_nuclei(df, "all")
    assert "partition by root_id" not in out._jdf.queryExecution().analyzed().toString().lower()
    got = sorted((r["root_id"], r["size_rank"], r["n_nuclei"]) for r in out.collect())
    assert got == [("A", i, 90) for i in range(1, 91)] + [("B", 1, 1)]


EDITS = "old_id long, new_id long, timestamp timestamp, share double"


def test_current_ids_over_chains_splits_and_merges(spark):
    chain = [(i, i + 1, f"2024-01-{i + 1:02d} 00:00:00", None) for i in range(20)]
    split = [(100, 101, "2024-01-01 00:00:00", 0.2), (100, 102, "2024-01-01 00:00:00", 0.8), (102, 104, "2024-01-02 00:00:00", None), (102, 103, "2024-01-02 00:00:00", None), (7, None, "2024-01-01 00:00:00", None), (8, 8, "2024-01-01 00:00:00", None)]
    edits = spark.createDataFrame([(a, b, t, s) for a, b, t, s in chain + split], "old_id long, new_id long, timestamp string, share double").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    ids = spark.createDataFrame([(0, "x"), (5, "x"), (20, "x"), (100, "x"), (101, "x"), (999, "x"), (None, "x"), (0, "y")], "root_id long, of string").withColumn("to", F.lit("clash"))
    got = lambda at: [(r["root_id"], r["latest_id"]) for r in versions.current_ids(ids, edits, at).orderBy("of", F.col("root_id").asc_nulls_last()).collect()]
    assert got(None) == [(0, 20), (5, 20), (20, 20), (100, 103), (101, 101), (999, 999), (None, None), (0, 20)]
    assert got(F.lit("2024-01-10 00:00:00").cast("timestamp"))[:4] == [(0, 10), (5, 10), (20, 20), (100, 103)]
    assert [r["latest_id"] for r in versions.current_ids(ids, edits.limit(0)).where("root_id = 0").collect()] == [0, 0]


def test_ids_in_a_circle_are_an_error(spark):
    edits = spark.createDataFrame([(1, 2, None, None), (2, 1, None, None)], EDITS)
    with pytest.raises(ValueError):
        versions.current_ids(spark.createDataFrame([(1,)], "root_id long"), edits)
