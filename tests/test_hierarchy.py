"""Morton codes, layered ids, and the nodes above supervoxels against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from axonframe.functions import chunks
from axonframe.operators import hierarchy, lookup

PARENTS = "child_id long, parent_id long, valid_from timestamp, valid_to timestamp"


def interleaved(x, y, z):
    return sum(((v >> i) & 1) << (3 * i + k) for i in range(chunks.AXIS_BITS) for k, v in enumerate((x, y, z)))


def test_codes_are_interleaved_bits_and_ancestors_are_prefixes(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(1 << chunks.AXIS_BITS) for _ in range(3)) for _ in range(200)] + [(0, 0, 0), (1023, 1023, 1023), (None, 1, 1)]
    df = spark.createDataFrame(rows, "x long, y long, z long").withColumn("code", chunks.morton(F.col("x"), F.col("y"), F.col("z")))
    df = df.withColumns({f"up{k}": chunks.chunk_at(F.col("code"), k) for k in (1, 2, 3, 5)}).withColumn("node", chunks.node_id(5, F.col("up5"), F.lit(77)))
    for r in df.select("*", chunks.layer_of(F.col("node")).alias("layer"), chunks.chunk_of(F.col("node")).alias("chunk")).collect():
        if r["x"] is None:
            assert r["code"] is None
            continue
        assert r["code"] == r["up1"] == r["up2"] == interleaved(r["x"], r["y"], r["z"])
        assert r["up3"] == interleaved(r["x"] >> 1, r["y"] >> 1, r["z"] >> 1) and r["up5"] == r["chunk"] == interleaved(r["x"] >> 3, r["y"] >> 3, r["z"] >> 3)
        assert r["layer"] == 5 and r["node"] > 0


def made(layer, number):
    return (layer << 55) + number


def test_layers_skips_moments_and_missing_parents(spark):
    n2, n3, n4 = made(2, 1), made(3, 1), made(4, 1)
    day = "2024-01-0{} 00:00:00"
    rows = [(10, n2, None, None), (n2, n3, day.format(1), day.format(5)), (n2, made(3, 9), day.format(5), None), (n3, n4, day.format(1), None), (11, n3, day.format(1), None), (12, None, day.format(1), None), (None, n2, day.format(1), None), (13, n2, day.format(1), None), (13, made(2, 0), day.format(1), None)]
    parents = spark.createDataFrame(rows, "child_id long, parent_id long, a string, b string").selectExpr("child_id", "parent_id", "coalesce(cast(a AS timestamp), timestamp'2000-01-01') AS valid_from", "cast(b AS timestamp) AS valid_to")
    voxels = spark.createDataFrame([(10, 8), (11, 8), (12, 0), (13, 1), (None, 1)], "supervoxel_id long, chunk long")
    at = lambda day_: {(r["supervoxel_id"], r["layer"]): (r["node_id"], r["chunk"]) for r in hierarchy.layer_nodes(voxels, parents, 4, F.lit(day.format(day_)).cast("timestamp")).collect()}
    early, late = at(2), at(6)
    assert early[10, 1] == (10, 8) and early[10, 2] == (n2, 8) and early[10, 3] == (n3, 1) and early[10, 4] == (n4, 0) == early[10, chunks.ROOT_LAYER]
    assert late[10, 3] == (made(3, 9), 1) and late[10, chunks.ROOT_LAYER] == (made(3, 9), 0)
    assert early[11, 2] == (11, 8) and early[11, 3] == (n3, 1)  # the parent skips layer 2
    assert early[12, chunks.ROOT_LAYER] == (12, 0) and early[13, 2] == (made(2, 0), 1)
    assert len(early) == 4 * 5


def test_lookup_stops_at_a_layer(spark):
    cells = spark.createDataFrame([(0, 0, 0, 10), (2, 0, 0, 11), (None, 0, 0, 12)], "cx long, cy long, cz long, supervoxel_id long")
    voxels = cells.where("cx is not null").withColumn("chunk", chunks.morton(*(F.floor(F.col(c) / 2) for c in ("cx", "cy", "cz"))))
    parents = spark.createDataFrame([(10, made(2, 5)), (made(2, 5), made(3, 6)), (11, made(2, 7)), (made(2, 7), made(3, 6))], "child_id long, parent_id long")
    nodes = hierarchy.layer_nodes(voxels, parents, 2)
    points = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 2.0, 0.5, 0.0), (3, 9.0, 0.0, 0.0), (4, None, 0.0, 0.0), (5, float("nan"), 0.0, 0.0)], "i int, x double, y double, z double").withColumns({c: F.lit("clash") for c in ("of", "place", "node", "sv", "code", "found", "cx", "segment_id")})
    ids = lambda layer: [r["segment_id"] for r in lookup.points_to_segments(points, cells, raw=True, integer=True, stop_layer=layer, nodes=nodes, chunk_cells=(2, 2, 2)).orderBy("i").collect()]
    assert ids(1) == [10, 11, 0, 0, 0] and ids(2) == [made(2, 5), made(2, 7), 0, 0, 0] and ids(None) == [made(3, 6), made(3, 6), 0, 0, 0]
    with pytest.raises(ValueError):
        lookup.points_to_segments(points, cells, stop_layer=2)
    with pytest.raises(ValueError):
        hierarchy.layer_nodes(voxels, parents, 99)
