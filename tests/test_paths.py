"""Tree paths by joins against plain Python, and a chain that spans many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from axonframe.operators import paths, skeleton

NODES = "root_id long, node_id long, parent_id long, x double, y double, z double"


def random_trees(seed, trees=6, size=60):
    rng, rows = random.Random(seed), []
    for t in range(trees):
        n = rng.randrange(1, size)
        names = rng.sample(range(1, 10 * size), n)
        for i, name in enumerate(names):
            rows.append((t, name, names[max(0, i - rng.choice([1, 1, 1, 2, 9]))] if i else -1, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 9)))
    rng.shuffle(rows)
    return rows


def walked(rows):
    """(root_id, node_id) -> (root node, length), by following parents one by one."""
    at = {(r, n): (p, (x, y, z)) for r, n, p, x, y, z in rows}
    out = {}
    for r, n in at:
        length, here = 0.0, n
        while (r, at[r, here][0]) in at:
            up = at[r, here][0]
            length += sum((a - b) ** 2 for a, b in zip(at[r, here][1], at[r, up][1])) ** 0.5
            here = up
        out[r, n] = (here, round(length, 6))
    return out


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_distances_of_random_trees(spark, monkeypatch, piece):
    rows = random_trees(piece)
    df = spark.createDataFrame(rows, NODES).repartition(3)
    tree = paths.edges(df).cache()
    # small pieces: contraction leaves most of the work to the rounds of joins
    monkeypatch.setattr(paths, "_contract", _with_piece(piece))
    got = {(r["root_id"], r["node_id"]): (r["top"], round(r["far"], 6)) for r in paths.climb(tree).collect()}
    assert got == walked(rows)
    marks = sorted({(r, n) for r, n, *_ in rows})[::4]
    pieces = paths.contracted(tree, F.lit(False))
    above = {(r["root_id"], r["node_id"]) for r in paths.ancestors(pieces, spark.createDataFrame(marks, "root_id long, node_id long")).collect()}
    parent = {(r, n): p for r, n, p, *_ in rows}
    want = set()
    for r, n in marks:
        while (r, n) in parent:
            want.add((r, n))
            n = parent[r, n]
    assert above == want


def _with_piece(piece):
    """_contract with pieces of so many nodes; the workers' module has the usual size."""
    plain = paths._contract

    def run(batches):
        from axonframe.operators import paths as own

        for batch in batches:
            for i in range(0, batch.num_rows, piece):
                yield from plain(iter([batch.slice(i, min(piece, 5000))]))

    return run


@pytest.mark.parametrize("seed", [11, 12])
def test_branch_points_of_random_trees(spark, seed):
    rows = random_trees(seed, trees=25)
    df = spark.createDataFrame(rows, NODES).repartition(3)
    got = {r["root_id"]: (r["node_id"], r["branched"]) for r in paths.branch_points(df).collect()}
    want = {}
    for t in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == t]
        want[t] = skeleton.key_node({n: (x, y, z) for _, n, _, x, y, z in mine}, {n: p for _, n, p, *_ in mine})
    assert got == want and any(b for _, b in want.values()) and not all(b for _, b in want.values())


def test_key_points_of_large_and_small_trees_agree(spark):
    df = spark.createDataFrame(random_trees(21, trees=9), NODES).union(spark.createDataFrame([(50, 1, 2, 0.0, 0.0, 0.0), (50, 2, 1, 1.0, 0.0, 0.0)], NODES))
    ids = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 50, 99)], "root_id long")
    rounded = lambda d: sorted((r["root_id"], r["failed"], r["branched"], None if r["x"] is None else round(r["x"], 9)) for r in d.collect())
    small = rounded(skeleton.key_points(df, ids))
    assert rounded(skeleton.key_points(df, ids, large=0)) == small == rounded(skeleton.key_points(df, ids, large=20))
    assert [r[:2] for r in small if r[1]] == [(50, True), (99, True)]


def test_cycles_nulls_repeats_and_empty_tables(spark):
    rows = [(1, 1, 2, 0.0, 0.0, 0.0), (1, 2, 1, 1.0, 0.0, 0.0), (1, 3, 2, 2.0, 0.0, 0.0), (2, 1, -1, 0.0, 0.0, 0.0), (2, 2, 1, 3.0, 4.0, 0.0), (2, 2, 1, 3.0, 4.0, 0.0), (None, 1, -1, 0.0, 0.0, 0.0), (3, None, -1, 0.0, 0.0, 0.0), (4, 5, 77, 1.0, 1.0, 1.0), (5, 1, -1, None, 0.0, 0.0), (5, 2, 1, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, NODES).withColumns({c: F.lit("clash") for c in ("r", "e", "p", "n", "up", "top")})
    got = sorted((tuple(r) for r in paths.distances(df).collect()), key=repr)
    assert got == [(1, 1, None, None), (1, 2, None, None), (1, 3, None, None), (2, 1, 1, 0.0), (2, 2, 1, 5.0), (4, 5, 5, 0.0), (5, 1, 1, 0.0), (5, 2, 1, 0.0)]
    none = spark.createDataFrame([], NODES)
    assert paths.distances(none).count() == 0 and paths.branch_points(none).count() == 0


def test_a_chain_of_a_million_nodes_spans_tasks(spark):
    n = 1_000_000
    chain = spark.range(n, numPartitions=8).select(F.lit(7).cast("long").alias("root_id"), "id", (F.col("id") - 1).alias("parent_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).withColumnRenamed("id", "node_id")
    out = paths.distances(chain)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"), F.count_if(F.expr("distance = node_id and top = 0")).alias("right")).first()
    assert (r["n"], r["d"], r["right"]) == (n, n - 1.0, n)
    tree = paths.edges(chain)
    pieces = paths.contracted(tree, F.lit(False))
    parts = pieces.select(F.input_file_name().alias("f"), "piece").distinct().collect()
    assert len({p["f"] for p in parts}) > 1 and pieces.where("open").count() > n / 2


def test_a_task_holds_a_piece_whatever_the_rows():
    """Contracting half a million nodes of one partition takes no more memory than a piece does, and no more than 32 MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def batches(n, size=10_000):
        for at in range(0, n, size):
            node = np.arange(at, min(at + size, n))
            up = pa.array(node - 1, mask=node == 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(node), np.int64)), pa.array(node), up, pa.array(np.ones(len(node))), pa.array(np.zeros(len(node), bool))], ["root_id", "node_id", "up", "length", "stop"])

    peaks = []
    for n in (70_000, 500_000):
        tracemalloc.start()
        rows, far = 0, 0.0
        for out in paths._contract(batches(n)):
            rows, far = rows + len(out), far + out.column("far").to_numpy().sum()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n and far >= n - 1
    assert peaks[1] < 32e6 and peaks[1] < 1.5 * peaks[0]
