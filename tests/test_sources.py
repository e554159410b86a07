import json

from pyspark.sql import functions as F

from axonframe.sources import scene, tables
from axonframe.streaming import edit_stream


def test_operation_cache(spark, tmp_path):
    cache = tables.OperationCache(spark, str(tmp_path), "stack")
    asked = []

    def fetch(ids):
        asked.append(sorted(r[0] for r in ids.collect()))
        return ids.where("operation_id <> 4").select("operation_id", F.lit("a").alias("user"), F.lit(1.0).alias("sink_x"))

    cache.append(spark.createDataFrame([(1, "z"), (2, "z")], "operation_id int, user string"))
    cache.append_missing(spark.createDataFrame([(9,)], "operation_id int"))
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "operation_id int")
    for _ in range(2):
        got = cache.details(wanted, fetch)
        assert sorted((r.operation_id, r.user) for r in got.collect()) == [(1, "z"), (2, "z"), (3, "a"), (5, "a")]
    assert asked == [[3, 4, 5]]
    ordered = spark.createDataFrame([(0, 5), (1, 1), (2, 5), (3, 77)], "ordinal int, operation_id int").where("operation_id <> 77")
    assert [(r.operation_id, r.user) for r in cache.details(ordered, fetch).orderBy("ordinal").collect()] == [(5, "a"), (1, "z"), (5, "a")]
    assert "sink_x" not in cache.read().columns
    cache.populate(spark.createDataFrame([(5, "new", "s"), (6, "b", "s")], "operation_id int, user string, status string"))
    assert sorted((r.operation_id, r.user, r.status) for r in cache.read().where("operation_id > 4").collect()) == [(5, "a", None), (6, "b", "s")]
    empty = tables.OperationCache(spark, str(tmp_path / "none"), "x")
    assert empty.read() is None and empty.read_missing().count() == 0


def test_cached_and_formats(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for end in ("csv", "json", "orc", "parquet"):
        path = str(tmp_path / f"f.{end}")
        df.write.option("header", True).format(end).save(path)
        assert sorted(map(tuple, tables.read_table(spark, path, "i int, s string").collect())) == [(1, "a"), (2, None)]
    assert tables.sql_over(spark, "SELECT count(*) AS n FROM {t}", t=df).first().n == 2
    assert [tuple(r) for r in tables.read_by_ids(df, spark.createDataFrame([(2,), (2,), (9,)], "x int"), "i", ["s"]).collect()] == [(None,)]
    assert "kind" in tables.list_tables(spark).columns


def test_info_writer(spark, tmp_path):
    df = spark.createDataFrame([("1", "A"), ("2", "B")], "root_id string, type string")
    text = tables.segment_properties(df)
    assert json.loads(text)["inline"]["ids"] == ["1", "2"]
    path = str(tmp_path / "d" / "info")
    assert tables.write_if_changed(text, path) and not tables.write_if_changed(text, path)
    assert tables.table_digest(df) == tables.table_digest(df.repartition(3).select("type", "root_id"))
    assert tables.table_digest(df) != tables.table_digest(df.limit(1))


def test_scene(spark, tmp_path):
    lines = [{"id": str(i), "type": "line", "pointA": [0.0, i, 0.0], "pointB": [10.0, i, 0.0]} for i in range(3)]
    (tmp_path / "scene.json").write_text(json.dumps({"layers": [{"type": "annotation", "name": "n", "annotations": [*lines, {"id": "p", "type": "point", "point": [1.0, 2.0, 3.0]}]}]}, indent=1))
    rows = scene.scene_annotations(spark, str(tmp_path / "scene.json"))
    assert rows.count() == 4
    a, b = scene.landmark_pairs(rows.where("type = 'line'"))
    assert a[1] == [0.0, 1.0, 0.0] and b[2] == [10.0, 2.0, 0.0]
    layer = scene.annotation_layer(spark.createDataFrame([(1, "1,2,3", "nucleus"), (2, None, None)], "root_id long, position string, source string"))
    assert [tuple(r) for r in layer.collect()] == [("1,2,3", "1", "soma: nucleus")]


def _log(spark, path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    who = F.when(F.col("user_id") % 2 == 0, "auto").otherwise("Wei lab")
    rows.select(F.col("event_id").cast("int").alias("operation_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("user"), who.alias("user_affiliation")).write.parquet(path)


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    _log(spark, folder)
    whole = spark.read.parquet(folder)
    cache = tables.OperationCache(spark, str(tmp_path / "cache"), "s")
    for k in range(2):
        edit_stream.ingest(edit_stream.read_stream(spark, folder, files_per_trigger=1), cache, str(tmp_path / f"c{k}")).awaitTermination()
    assert cache.read().count() == whole.select("operation_id").distinct().count()
    counts = edit_stream.run_to_end(edit_stream.windowed_counts(edit_stream.read_stream(spark, folder)), "complete", str(tmp_path / "c3"), str(tmp_path / "o3"))
    batch = edit_stream.windowed_counts(whole)
    last = counts.where(F.col("batch") == counts.agg(F.max("batch")).first()[0]).drop("batch")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))
    users = edit_stream.run_to_end(edit_stream.last_per_user(edit_stream.read_stream(spark, folder)), "update", str(tmp_path / "c4"), str(tmp_path / "o4"))
    want = {r.user: (r.m, r.n) for r in whole.groupBy("user").agg(F.max("operation_id").alias("m"), F.count("*").alias("n")).collect()}
    assert {r.user: (r.last_operation, r.n) for r in users.collect()} == want
    sessions = edit_stream.edit_sessions(whole)
    assert sessions.agg(F.sum("n")).first()[0] == whole.count()
