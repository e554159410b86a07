"""Small cases whose results are known by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.functions import coords, edits as edit_functions
from axonframe.functions.scoring import SomaModel, distance_penalty
from axonframe.operators import edits, geometry, lookup, maintenance, metadata, nuclei, partners, skeleton, soma, training, versions
from axonframe.plans import registry
from axonframe.sources.scene import DatasetConfig

NUCLEI = "id int, pt_root_id string, pt_position string, volume double"


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(101, "A", "10,10,10", 1000.0), (102, "A", "20,20,20", 5000.0), (103, "B", "30,30,30", 2000.0)], [("A", "20,20,20", 2, 102), ("B", "30,30,30", 1, 103)]),
        ([(13899, "A", "488832,112816,158850", 775.9), (16468, "A", "488832,112816,158850", 775.9)], [("A", "488832,112816,158850", 1, 13899)]),
        ([(101, "A", "10,10,10", 1000.0), (102, "A", "20,20,20", 5000.0), (103, "A", "20,20,20", 5000.0), (104, "B", "30,30,30", 2000.0), (105, "B", "30,30,30", 2000.0)], [("A", "20,20,20", 2, 102), ("B", "30,30,30", 1, 104)]),
        ([(None, "A", None, None), (2, "B", "30,30,30", 2000.0)], [("B", "30,30,30", 1, 2)]),
        ([(1, "A", "1,1,1", None), (2, "A", "2,2,2", 5.0)], [("A", "2,2,2", 2, 2)]),
    ],
)
def test_nuclei(spark, rows, want):
    assert tuples(nuclei.dedup_nuclei(spark.createDataFrame(rows, NUCLEI)), "root_id", "position", "n_nuclei", "nucleus_id") == want


def test_nuclei_all_and_errors(spark):
    df = spark.createDataFrame([(101, "A", "10,10,10", 1000.0), (102, "A", "20,20,20", 5000.0)], NUCLEI)
    assert tuples(nuclei.dedup_nuclei(df, "all"), "root_id", "size_rank", "position", "n_nuclei") == [("A", 1, "20,20,20", 2), ("A", 2, "10,10,10", 2)]
    with pytest.raises(ValueError, match="id, volume"):
        nuclei.dedup_nuclei(df.select("pt_root_id", "pt_position"))


STRAIGHT = [(1, i + 1, i if i else -1, 1e4 * i, 1e5, 1e5, 1.0) for i in range(5)]
NODES = "root_id long, node_id int, parent_id int, x double, y double, z double, w double"


def test_root_point_and_reroot(spark):
    nodes = spark.createDataFrame(STRAIGHT, NODES)
    for target, node in (((3.9e4, 1e5, 1e5), 5), ((0.0, 1e5, 1e5), 1)):
        points = spark.createDataFrame([(1, *target)], "root_id long, px double, py double, pz double")
        assert [r.node_id for r in skeleton.root_points(nodes, points).collect()] == [node]
    turned = skeleton.reroot(nodes, spark.createDataFrame([(1, 5)], "root_id long, node_id int"))
    assert tuples(turned, "node_id", "parent_id") == [(1, 2), (2, 3), (3, 4), (4, 5), (5, -1)]
    mesh = box_mesh((-1e3, 0, 0), (3.5e4, 2e5, 2e5))
    assert [r.node_id for r in skeleton.root_points(nodes, mesh=mesh).collect()] == [5]
    none = spark.createDataFrame([(1, float("nan"), 0.0, 0.0)], "root_id long, px double, py double, pz double")
    assert [r.node_id for r in skeleton.root_points(nodes, none, mesh=mesh).collect()] == [5]
    assert skeleton.root_points(nodes).count() == 0
    with pytest.raises(ValueError):
        skeleton.root_points(nodes, method="mesh")


def box_mesh(low, high):
    corners = np.array([(x, y, z) for x in (low[0], high[0]) for y in (low[1], high[1]) for z in (low[2], high[2])], float)
    faces = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    return geometry.Mesh(corners, np.array(faces))


def test_signed_distance():
    mesh = box_mesh((0, 0, 0), (10, 10, 10))
    points = np.array([[5, 5, 1], [5, 5, 12], [13, 14, 5], [5, 5, 5], [-3, -4, -12]], float)
    assert np.allclose(mesh.signed_distance(points), [1, -2, -5, 5, -13])


def test_key_point(spark):
    rows = [(1, 1, -1, 0.0, 0.0, 0.0, 1.0), (1, 2, 1, 10.0, 0.0, 0.0, 1.0), (1, 3, 2, 30.0, 0.0, 0.0, 1.0), (1, 4, 2, 10.0, 5.0, 0.0, 1.0), (2, 1, 9, 0.0, 0.0, 0.0, 1.0), (3, 1, 1, 0.0, 0.0, 0.0, 1.0)]
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "root_id long")
    got = {r.root_id: r for r in skeleton.key_points(spark.createDataFrame(rows, NODES), ids, raw=False).collect()}
    assert (got[1].x, got[1].y, got[1].z, got[1].branched) == (10.0, 0.0, 0.0, True)
    assert not got[2].branched and got[2].x == 0.0
    assert got[3].failed and got[4].failed and got[4].x is None


def test_coordinates(spark):
    df = spark.createDataFrame([(1000.0, 2000.0, 3000.0), (1500.0, 2500.0, 3500.0)], "x double, y double, z double")
    assert coords.raw_to_nm(coords.nm_to_raw(df, (2, 4, 5)), (2, 4, 5)).collect() == df.collect()
    texts = spark.createDataFrame([("1,2,3",), (" 1, 2.5 , 3 ",), ("488832 112816\t158850",), ("1,2",), ("a,b,c",), (None,), ("",)], "s string")
    p = coords.parse_xyz(F.col("s"))
    assert [r[0] for r in texts.select(coords.format_xyz(p["x"], p["y"], p["z"])).collect()] == ["1,2,3", "1,2.5,3", "488832,112816,158850", None, None, None, None]
    soma_nm = coords.raw_to_nm(spark.createDataFrame([(16231.0, 4747.0, 3051.0)], "x double, y double, z double"))
    assert tuple(soma_nm.first()) == (259696.0, 75952.0, 137295.0)


def test_mirror(spark):
    a = [(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1)]
    b = [(10, y, z) for _, y, z in a]
    df = spark.createDataFrame([(2.0, 0.5, 0.5), (8.0, 0.5, 0.5), (None, 1.0, 1.0)], "x double, y double, z double")
    for swap in (geometry.mirror_landmarks(a, b, raw=False), geometry.mirror_landmarks(a, [(5, y, z) for _, y, z in a], voxel=(2, 1, 1))):
        rows = geometry.mirror(df, "landmarks", swap=swap).collect()
        assert [None if r.m_x is None else round(r.m_x, 6) for r in rows] == [8.0, 2.0, None]
    with pytest.raises(ValueError, match="pointA and pointB"):
        geometry.mirror_landmarks(a, None)
    rng = np.random.default_rng(0)
    source = rng.normal(size=(9, 3))
    target = source + rng.normal(size=(9, 3)) * 0.1
    assert np.allclose(geometry.ThinPlateSpline.fit(source, target)(source), target)


def test_sides(spark):
    df = spark.createDataFrame([(80.0,), (20.0,), (50.0,), (45.0,), (46.0,), (None,)], "x double")
    d = geometry.side_distance(F.col("x"), 100 - F.col("x"))
    rows = df.select(d, geometry.side_of(d, 5), geometry.side_of(d, 0)).collect()
    assert [r[0] for r in rows] == [-30, 30, 0, 5, 4, None]
    assert [r[1] for r in rows] == ["L", "R", "M", "R", "M", None]
    assert rows[2][2] == "R"
    with pytest.raises(ValueError):
        geometry.side_of(d, -1)


def test_versions(spark):
    with pytest.warns(UserWarning):
        assert versions.get_version(version=5, timestamp="x") == versions.VersionInfo(version=5)
    assert versions.get_version(timestamp="2026-01-01") == versions.VersionInfo(timestamp="2026-01-01")
    assert versions.get_version("latest").version == "latest" and versions.get_version(300).version == 300
    assert versions.get_version("now") == versions.VersionInfo(timestamp="now")
    with versions.default_version("now"):
        assert versions.get_version().timestamp == "now"
    assert versions.get_version().version == "latest"
    table = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (2, "2026-01-01 00:00:00")], "version int, timestamp string")
    assert spark.range(1).select(versions.moment(versions.VersionInfo("latest"), table).cast("string")).first()[0] == "2026-01-01 00:00:00"


def test_refresh_ids(spark):
    pin = "2026-06-01 14:10:01"
    before = [(75858402798114673, 648518347553078030), (75014527154012478, 648518347517237712), (74100420741808116, 648518347497891440), (0, 5), (None, 6)]
    history = [(75858402798114673, 648518347553078030, "2026-01-01", "2026-05-01"), (75858402798114673, 648518347511736893, "2026-05-01", None), (75014527154012478, 648518347643419800, "2026-06-01 14:10:01", "2026-07-01"), (74100420741808116, 648518347497891440, "2026-01-01", None), (0, 99, "2020-01-01", None)]
    df = spark.createDataFrame([(i, s, r, "1,2,3") for i, (s, r) in enumerate(before)], "_id int, supervoxel_id long, root_id long, point_xyz string")
    h = spark.createDataFrame(history, "supervoxel_id long, root_id long, valid_from string, valid_to string").withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})
    out = maintenance.sequential_update(df, h, F.lit(pin).cast("timestamp"))
    assert out.columns == df.columns
    assert tuples(out, "_id", "root_id") == [(0, 648518347511736893), (1, 648518347643419800), (2, 648518347497891440), (3, 5), (4, 6)]
    filled = maintenance.sequential_update(df, h, F.lit(pin).cast("timestamp"), spark.createDataFrame([(3, 74100420741808116), (0, 1)], "_id int, found long"))
    assert tuples(filled.where("_id in (0, 3)"), "_id", "root_id") == [(0, 648518347511736893), (3, 648518347497891440)]


def test_flags_and_changes(spark):
    df = spark.createDataFrame([(1, 7, None), (2, 7, None), (3, 7, "duplicate"), (4, 8, None)], "_id int, root_id long, status string")
    assert tuples(maintenance.flag_duplicates(df), "_id", "root_duplicated") == [(1, True), (2, True), (3, False), (4, False)]
    cells = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b"), ("a", None), (None, None)], "o string, n string")
    assert [r[0] for r in cells.select(maintenance.cell_changed(F.col("o"), F.col("n"))).collect()] == [False, True, True, False, False]
    serials = spark.createDataFrame([(1, "0007"), (2, "0012"), (3, None), (4, None)], "_id int, serial_id string")
    assert tuples(maintenance.assign_serials(serials), "_id", "serial_id") == [(1, "0007"), (2, "0012"), (3, "0013"), (4, "0014")]
    with pytest.raises(ValueError):
        maintenance.check_unique(df, "root_id")
    ids = spark.createDataFrame([(7,), (9,), (9,), (0,)], "root_id long")
    with pytest.raises(ValueError, match="more rows to update than ids"):
        maintenance.add_neurons(df, ids)
    with pytest.raises(ValueError, match="duplicate rows by _id"):
        maintenance.add_neurons(df.union(df.where("_id = 4")), spark.createDataFrame([(8,)], "root_id long"))
    parts = maintenance.add_neurons(df, ids, strict=False, cell_class="KC")
    assert tuples(parts["up"], "_id", "cell_class") == [(1, "KC"), (2, "KC"), (3, "KC")] and tuples(parts["new"], "root_id") == [(9,)]


def test_update_table(spark):
    df = spark.createDataFrame([(1, 10, 7, None, None, "0001"), (2, 11, 7, None, None, None), (3, 12, 9, "duplicate", None, None)], "_id int, supervoxel_id long, root_id long, status string, root_duplicated boolean, serial_id string")
    h = spark.createDataFrame([(10, 8), (11, 8), (12, 5)], "supervoxel_id long, root_id long").withColumns({"valid_from": F.lit("2020-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    at = F.lit("2024-01-01").cast("timestamp")
    after, changed = maintenance.update_table(df, h, at, serials=True)
    assert tuples(after, "_id", "root_id", "root_duplicated", "serial_id") == [(1, 8, True, "0001"), (2, 8, True, "0002"), (3, 5, False, "0003")]
    assert changed.count() == 3
    after, changed = maintenance.update_table(df, h, at, update_duplicates=False)
    assert tuples(after, "_id", "root_id") == [(1, 8), (2, 8), (3, 9)] and changed.count() == 2


def test_common_schema(spark):
    rows = [(1, "h", "s", "c", "b", "z", None, "T", "L"), (2, "h", "s", "c", "b", "z", None, "T", None), (3, "h", "s", "c", "b", "z", None, None, "R"), (4, "h", "s", "c", "b", "z", "x", "T", "L")]
    df = metadata.common_schema(spark.createDataFrame(rows, "root_id int, hemilineage string, superclass string, class string, subclass string, subsubclass string, instance string, type string, side string"))
    assert [r.instance for r in df.orderBy("id").collect()] == ["T_L", "T_", "NA_R", "x"]
    assert tuple(df.first())[:5] == (1, "h", "s", "c", "b")
    with pytest.raises(ValueError, match="side"):
        metadata.common_schema(df.drop("side").withColumnRenamed("id", "root_id"))


def test_predicates(spark):
    df = spark.createDataFrame([("MBON01",), ("mbon02",), ("xMBON",), (None,), ("a.b",), ("axb",)], "class string")
    find = lambda *a, **k: [r[0] for r in df.where(metadata.query_predicate(*a, **k)).collect()]
    assert find("class:MBON.*") == ["MBON01"] and find("/class:mbon.*", ignore_case=True) == ["MBON01", "mbon02"]
    assert find("class:a.b") == ["a.b", "axb"] and find("class:a.b", fixed=True) == ["a.b"]
    with pytest.raises(ValueError):
        metadata.query_predicate("class")


def test_partners(spark):
    rows = [(1, 2)] * 3 + [(1, 3)] * 2 + [(1, 4)] + [(5, 2)] * 2
    syn = spark.createDataFrame(rows, "pre_root long, post_root long")
    ids = spark.createDataFrame([(1,), (1,)], "id long")
    assert tuples(partners.partners_at_least(syn, ids, threshold=2), "partner", "weight") == [(2, 3), (3, 2)]
    assert tuples(partners.partner_summary(syn, spark.createDataFrame([(2,)], "id long"), "inputs"), "partner", "weight") == [(1, 3), (5, 2)]
    cosine = partners.cosine_similarity(partners.partner_summary(syn)).first()
    assert math.isclose(cosine.cosine, 3 / math.sqrt(14))


def test_points_to_segments(spark):
    cells = spark.createDataFrame([(0, 0, 0, 10), (1, 0, 0, 11)], "cx long, cy long, cz long, supervoxel_id long")
    points = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, None, 1.0, 1.0), (3, 1.2, 0.0, 0.9), (4, 9.0, 9.0, 9.0)], "i int, x double, y double, z double")
    assert tuples(lookup.points_to_segments(points, cells, raw=True), "i", "segment_id") == [(1, "10"), (2, "0"), (3, "11"), (4, "0")]


def test_lookup_service(spark):
    def fetch(rows):
        if any(x == -1 for x, _, _ in rows):
            raise OSError("no")
        return ["123"] * len(rows)

    points = spark.createDataFrame([(float(x), 0.0, 0.0) for x in (1, 1, -1, -1, 1, 1)], "x double, y double, z double").coalesce(1)
    assert [r.segment_id for r in lookup.lookup_service(points, fetch, 2).collect()] == ["123", "123", "0", "0", "123", "123"]
    with pytest.raises(Exception, match="no"):
        lookup.lookup_service(points, fetch, 10).collect()


def test_edit_log(spark):
    text = json.dumps({"101": {"timestamp": "2026-01-01T00:00:00Z", "user": "a"}, "102": {"timestamp": "2026-01-02T00:00:00Z", "user": "b"}})
    got = edits.details_from_json(spark.createDataFrame([(text,)], "json string"))
    assert dict(got.dtypes)["operation_id"] == "int" and dict(got.dtypes)["timestamp"] == "timestamp"
    assert tuples(got, "operation_id", "user") == [(101, "a"), (102, "b")]
    assert edits.details_from_json(spark.createDataFrame([("{}",)], "json string")).count() == 0
    for bad in ('[{"user": "a"}]', '{"x": {"user": "a"}}'):
        with pytest.raises(Exception, match="valid operation IDs"):
            edits.details_from_json(spark.createDataFrame([(bad,)], "json string")).collect()
    c = edit_functions.centroid(F.col("s"))
    rows = spark.createDataFrame([("1,2,3,4,5,6",), (None,), ("NA",), ("1,2",)], "s string").select(c["x"], c["y"], c["z"]).collect()
    assert [tuple(r) for r in rows] == [(1.5, 3.5, 5.5)] + [(None,) * 3] * 3


def test_frames(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (10,)], "s long").select(F.timestamp_seconds("s").alias("t"))
    frame = edit_functions.frame_of(F.col("t"), F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(10)), 2)
    assert [r[0] for r in df.select(frame).collect()] == [1, 1, 2, 2]


def test_penalty(spark):
    model = SomaModel([0.0] * 5, np.eye(5).tolist(), (-200.0, 50.0), [0.004, 0.012, 0.004])
    rows = spark.createDataFrame([(-200.0,), (-75.0,), (51.0,), (None,)], "d double").select(distance_penalty(model, F.col("d"))).collect()
    floor = -2 * math.log(4e-6 / 0.012)
    assert np.allclose([r[0] for r in rows], [-2 * math.log(1 / 3), 0, floor, floor])


def test_soma_cascade(spark):
    chunk = "root_id long, l2_id long, rep_coord_nm_x double, rep_coord_nm_y double, rep_coord_nm_z double, area_nm2 double, size_nm3 double, max_dt_nm double, mean_dt_nm double, pca_val_0 double, pca_val_2 double"
    chunks = spark.createDataFrame([(3, 30, 5.0, 5.0, 5.0, 10.0, 10.0, 10.0, 10.0, 1.0, 1.0), (3, 31, 50.0, 5.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (5, 50, 1.0, 1.0, 1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0), (6, 60, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0)], chunk)
    model = SomaModel([math.log(2)] * 4 + [1.0], np.eye(5).tolist(), (-200.0, 50.0), [0.004, 0.012, 0.004])
    annotations = spark.createDataFrame([(1, 1, "10,10,10", 5), (2, 1, "11,11,11", 6), (3, 2, "", None)], "_id int, root_id long, soma_xyz string, nucleus_id int")
    nuc = spark.createDataFrame([(9, 1, "1,1,1", 1.0), (10, 2, "7,7,7", 1.0)], "id int, pt_root_id long, pt_position string, volume double")
    ids = spark.createDataFrame([(0, 4), (1, 3), (2, 2), (3, 1), (4, 2), (5, 5), (6, 6)], "ordinal int, root_id long")
    parts = dict(annotations=annotations, nuclei=nuc, membership=chunks.select("root_id", "l2_id"), attributes=chunks.drop("root_id"), model=model)
    got = soma.soma_positions(ids, mesh=box_mesh((0, 0, 0), (100, 100, 100)), **parts).orderBy("ordinal").collect()
    assert [(r.root_id, r.position, r.source) for r in got] == [(4, None, None), (3, "50,5,5", "l2+mesh"), (2, "7,7,7", "nucleus"), (1, "160,160,450", "annotation"), (2, "7,7,7", "nucleus"), (5, "1,1,1", "l2+mesh"), (6, None, None)]
    assert got[3].nucleus_id == 5 and got[2].dist_npil_nm == 7.0 and got[5].soma_score is None
    raw = soma.soma_positions(ids.where("root_id = 1"), units="raw", **parts).first()
    assert raw.position == "10,10,10"
    with pytest.raises(ValueError):
        soma.soma_positions(ids, "mesh", **parts)


def test_fit_model(spark):
    rng = np.random.default_rng(3)
    chunk = "root_id long, l2_id long, area_nm2 double, size_nm3 double, max_dt_nm double, mean_dt_nm double, pca_val_0 double, pca_val_2 double"
    rows = [(i % 7, i, *map(float, rng.uniform(1, 100, 5)), float(rng.uniform())) for i in range(200)]
    df = spark.createDataFrame(rows, chunk)
    d = spark.createDataFrame([(float(v),) for v in rng.normal(-20, 15, 300)], "um double")
    model = training.fit_soma_model(df.where("l2_id < 120"), df.where("l2_id >= 120"), d, "um", points=128)
    assert model.counts == {"positive": 120, "negative": 80} and len(model.density) == 128
    assert abs(sum(model.density) * 250 / 127 - 1) < 0.02
    assert SomaModel.from_json(model.to_json()) == model
    sample = training.soft_negatives(df, 10)
    assert sample.count() == 70 and sample.count() == training.soft_negatives(df, 10).intersect(sample).count()


def test_registry(spark):
    scene = {"layers": [{"type": "image", "source": "x"}, {"type": "segmentation", "source": "graph://host/table/stack_v2"}]}
    config = DatasetConfig.from_scene(json.dumps(scene))
    assert config.datastack == "stack_v2"
    with registry.using(config):
        assert registry.current() is config
    with pytest.raises(ValueError):
        registry.current()
    a = spark.createDataFrame([(1, "x")], "id int, type string")
    b = spark.createDataFrame([(2, "L")], "id int, side string")
    for name, df in (("one", a), ("two", b)):
        registry.register(registry.Adapter(name, lambda q, df=df: df, None, None))
    assert tuples(registry.query(one="type:x", two="side:L").fillna(""), "dataset", "id", "type", "side") == [("one", 1, "x", ""), ("two", 2, "", "L")]
    assert not registry.require_package("no_such_package_here", False)
    with pytest.raises(ImportError):
        registry.require_package("no_such_package_here")


def test_read_neurons(spark):
    nodes = spark.createDataFrame(STRAIGHT, NODES)
    ids = spark.createDataFrame([(0, 1), (1, 2)], "ordinal int, root_id long")
    somata = spark.createDataFrame([(1, "39000,100000,100000", "nucleus", 1, 4, None, None, None), (2, None, None, None, None, None, None, None)], soma.RESULT)
    out, neurons = skeleton.read_neurons(nodes, ids, somata, units="microns")
    assert tuples(out.where("parent_id = -1"), "node_id", "x") == [(5, 40.0)]
    assert tuples(neurons.fillna("none"), "ordinal", "root_id", "soma_source") == [(0, 1, "nucleus"), (1, 2, "none")]
    again, _ = skeleton.read_neurons(nodes.limit(0), ids, previous=nodes)
    assert again.count() == 5


def test_training_points(spark):
    mesh = box_mesh((0, 0, 0), (10_000, 10_000, 10_000))
    nuc = spark.createDataFrame([(1, "5000,5000,1000"), (2, "5000,5000,-2000"), (3, None)], "id int, pt_position string")
    assert tuples(training.neuropil_distances(nuc, mesh).fillna(0.0).fillna("none"), "id", "dist_um", "where") == [(1, 1.0, "inside"), (2, -2.0, "outside"), (3, 0.0, "none")]
    chunks = spark.createDataFrame([(10, 1, 1.0, 1.0, 1.0), (10, 2, 5.0, 5.0, 5.0), (11, 3, 0.0, 0.0, 0.0)], "root_id long, l2_id long, rep_coord_nm_x double, rep_coord_nm_y double, rep_coord_nm_z double")
    cells = spark.createDataFrame([(4, 4, 4, 10)], "cx long, cy long, cz long, supervoxel_id long")
    points = spark.createDataFrame([(4.5, 4.5, 4.5), (900.0, 0.0, 0.0)], "x double, y double, z double")
    assert tuples(training.hard_negatives(chunks, points, cells), "root_id", "l2_id") == [(10, 2)]


def test_fetch_operations(spark):
    ids = spark.range(1, 8).select(F.col("id").cast("int").alias("operation_id")).coalesce(1)

    def fetch(wanted):
        assert len(wanted) <= 3
        return json.dumps({str(i): {"user": f"u{i}"} for i in wanted if i != 4})

    assert tuples(edits.fetch_operations(ids, fetch, 3), "operation_id", "user") == [(i, f"u{i}") for i in (1, 2, 3, 5, 6, 7)]


def test_first_rows_under_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 7, "b"), (1, 7, "a"), (None, 8, "x"), (2, 8, "y"), (None, 9, "z"), (3, None, "n")], "_id int, root_id long, v string")
    first, several = metadata.unique_rows(df)
    assert first.columns == df.columns
    assert sorted(map(repr, (tuple(r) for r in first.collect()))) == sorted(map(repr, [(1, 7, "a"), (2, 8, "y"), (None, 9, "z"), (3, None, "n")]))
    assert several.count() == 4
    log = spark.createDataFrame([(5, "b", 2), (5, "a", 1), (6, "c", 1)], "operation_id int, user string, timestamp int")
    wanted = spark.createDataFrame([(0, 6), (1, 5), (2, 5), (3, 99)], "ordinal int, operation_id int")
    assert tuples(edits.in_requested_order(wanted, log), "ordinal", "operation_id", "user") == [(0, 6, "c"), (1, 5, "a"), (2, 5, "a")]


def test_query_matches_the_whole_field(spark):
    df = spark.createDataFrame([("PROMO",), ("PROMO\n",), ("PROMOS",)], "a string")
    assert df.where(metadata.query_predicate("a:PROMO")).count() == 1


def test_colours_are_the_fixed_ones(spark):
    from axonframe.functions.edits import affiliation_colour

    df = spark.createDataFrame([("auto",), ("autos",), ("Cambridge, UK",), ("Dacks Lab",), (None,)], "a string")
    assert [r[0] for r in df.select(affiliation_colour(F.col("a"))).collect()] == ["grey", "black", "#A3E1CD", "#A41034", "black"]
    assert [r[0] for r in df.select(affiliation_colour(F.col("a"), (("s$", "red"),), "none")).collect()] == ["none", "red", "none", "none", "none"]


def test_sources_of_somata_are_cut_to_wanted_roots_first(spark):
    """The semi join stands below the aggregate, so that other roots are never grouped."""
    from axonframe.operators import soma

    ids = spark.createDataFrame([(1, 10)], "ordinal int, root_id long")
    annotations = spark.createDataFrame([(1, 10, "1,2,3"), (2, 11, "4,5,6")], "_id int, root_id long, soma_xyz string")
    nuclei = spark.createDataFrame([(1, 11, "1,2,3", 1.0)], "id int, pt_root_id long, pt_position string, volume double")
    df = soma.soma_positions(ids, annotations=annotations, nuclei=nuclei)
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda kind: [len(l) - len(l.lstrip(" :+-")) for l in lines if kind in l]
    assert max(depth("LeftSemi")) > min(depth("Aggregate [root_id"))
    assert df.count() == 1
