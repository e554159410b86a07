"""Wrappers of the chosen dataset, batches, expiry, documents for viewers, known somata, names that clash, and the guard."""

import json
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.functions.scoring import SomaModel
from axonframe.functions.shared import fresh
from axonframe.operators import edits, geometry, lookup, maintenance, metadata, skeleton, soma
from axonframe.plans import edit_log, registry
from axonframe.sources import tables
from axonframe.sources.scene import DatasetConfig


def test_wrappers_ask_the_dataset_that_is_chosen(spark, tmp_path):
    asked = []

    def fetch(ids):
        asked.append(sorted(r[0] for r in ids.collect()))
        return ids.where("operation_id <> 3").select("operation_id", F.lit("1,3,5,7,9,11").alias("sink_coords"), F.lit("NA").alias("source_coords"))

    with pytest.raises(ValueError):
        edit_log.last_edit(spark, str(tmp_path))
    with registry.using(DatasetConfig("one")):
        assert edit_log.last_edit(spark, str(tmp_path)) is None
        with pytest.raises(ValueError):
            edit_log.all_operations(spark, fetch, str(tmp_path))
        wanted = spark.createDataFrame([(2,), (5,), (3,)], "operation_id int")
        got = edit_log.operation_details(spark, wanted, fetch, str(tmp_path), centroids=True).collect()
        assert sorted((r["operation_id"], r["sink_x"]) for r in got) == [(2, 2.0), (5, 2.0)] and asked == [[2, 3, 5]]
        assert edit_log.last_edit(spark, str(tmp_path)) == 5 and edit_log.last_edit(spark, str(tmp_path), 1, 5) == 2
        assert sorted(r["operation_id"] for r in edit_log.all_operations(spark, fetch, str(tmp_path)).collect()) == [1, 2, 4, 5] and asked[1:] == [[1, 4]]
    with registry.using(DatasetConfig("two")):
        assert edit_log.last_edit(spark, str(tmp_path)) is None


def test_bounds_of_operations_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(10).select(F.col("id").cast("int").alias("operation_id")).write.parquet(path)
    out = edits.all_operations(spark.read.parquet(path), 7)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(operation_id,1)" in text and "LessThanOrEqual(operation_id,7)" in text and "Exchange" not in text
    assert sorted(r[0] for r in out.collect()) == list(range(1, 8))


def test_batches_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 23, i) for i in range(23)], "t int, by int").repartition(4)
    got = sorted((r["t"], r["place"], r["batch"]) for r in edits.batches(df, ["t"], 5).collect())
    assert got == [(i, i + 1, i // 5 + 1) for i in range(23)]
    with pytest.raises(ValueError):
        edits.batches(df, ["t"], 0)


def test_a_cached_table_expires(spark, tmp_path):
    calls, path = [], str(tmp_path / "t")
    build = lambda: calls.append(1) or spark.range(2)
    tables.cached(spark, path, build, expires=1000)
    tables.cached(spark, path, build, expires=1000)
    assert len(calls) == 1 and 0 <= tables.age_seconds(spark, path) < 500
    time.sleep(1.2)
    tables.cached(spark, path, build, expires=1)
    assert len(calls) == 2


def test_properties_are_written_by_tasks_and_once(spark, tmp_path):
    rows = [(str(i), f'say "{i % 3}"\\ é', None if i % 2 else "x") for i in range(60)]
    df = spark.createDataFrame([*rows, (None, "lost", "y")], "root_id string, type string, class string").repartition(5)
    path = str(tmp_path / "p")
    assert tables.write_properties(df, path) and not tables.write_properties(df.repartition(2), path)
    text = "".join(r[0] for r in spark.read.text(f"{path}/info", wholetext=True).collect())
    assert json.loads(text) == json.loads(tables.segment_properties(df.where("root_id is not null")))
    assert tables.write_properties(df.limit(0), path) and json.loads("".join(r[0] for r in spark.read.text(f"{path}/info").collect()))["inline"]["ids"] == []


def test_known_somata_get_their_chunks_scores(spark):
    model = SomaModel([0.0] * 5, np.eye(5).tolist(), (-200.0, 50.0), [0.004, 0.008, 0.004])
    corners = np.array([(x, y, z) for x in (0, 100) for y in (0, 100) for z in (0, 100)], float)
    faces = np.array([(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)])
    mesh = geometry.Mesh(corners, faces)
    rows = spark.createDataFrame([(1, "50,50,40", "a", None, None, None, None, None), (2, "500,0,0", "a", None, None, None, None, None), (3, None, "a", None, None, None, None, 77), (1, "5,50,50", "a", None, None, None, None, None)], soma.RESULT)
    n2 = (2 << 55) + 5
    cells = spark.createDataFrame([(0, 0, 0, 10)], "cx long, cy long, cz long, supervoxel_id long")
    nodes = spark.createDataFrame([(2, 0, 10, n2)], "layer int, chunk long, supervoxel_id long, node_id long")
    attributes = spark.createDataFrame([(n2, 50.0, 50.0, 40.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5), (4, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5)], "l2_id long, rep_coord_nm_x double, rep_coord_nm_y double, rep_coord_nm_z double, area_nm2 double, size_nm3 double, max_dt_nm double, mean_dt_nm double, pca_val_0 double, pca_val_2 double")
    space = lookup.Space(cells, nodes, cell=(10.0, 10.0, 10.0))
    got = {r["position"]: r for r in soma.with_known_scores(rows, mesh, space, attributes, model).collect()}
    want = soma.score_chunks(attributes.where(F.col("l2_id") == n2), model, mesh, "l2+mesh").first()["soma_score"]
    assert got["50,50,40"]["l2_id"] == got["5,50,50"]["l2_id"] == n2 and got["50,50,40"]["soma_score"] == got["5,50,50"]["soma_score"] == pytest.approx(want)
    assert got["50,50,40"]["dist_npil_nm"] == pytest.approx(40) and got["500,0,0"]["l2_id"] is None and got["500,0,0"]["dist_npil_nm"] == pytest.approx(-400)
    assert got[None]["l2_id"] == 77 and got[None]["dist_npil_nm"] is None


def test_neurons_without_soma_are_counted(spark):
    neurons = spark.createDataFrame([(1, "a"), (2, None)], "root_id long, soma_source string")
    with pytest.warns(UserWarning, match="1 of 2"):
        assert skeleton.warn_unplaced(neurons) == 1
    assert tuple(skeleton.unplaced(neurons.limit(0)).first()) == (0, 0)


def test_helper_names_never_clash(spark):
    df = spark.createDataFrame([(1, 1, "duplicate", 5), (1, 2, None, 6), (2, 3, None, 7)], "root_id int, _id int, status string, v int").withColumns({c: F.lit("x") for c in ("of", "of_0", "__type", "__key", "__row", "__n", "first", "rows", "total", "many", "__k")})
    assert fresh("of", df) == "of_1" and fresh("OF_0", df) == "OF_0_0"
    assert metadata.add_count(df, "root_id").where("n = 2").count() == 2
    first, several = metadata.unique_rows(df)
    assert sorted(r["_id"] for r in first.collect()) == [1, 3] and several.count() == 2
    assert sorted((r["_id"], r["root_duplicated"]) for r in maintenance.flag_duplicates(df).collect()) == [(1, False), (2, False), (3, False)]


@pytest.mark.parametrize("blocked", ["ahocorasick", "axonframe.llm", "corpus_pipeline"])
def test_the_rest_registers_without_the_llm_operators(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'soma_cascade' in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert done.returncode == 0, done.stderr[-800:]
