"""Similar profiles, inverted splines, welded meshes and keyed tables."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from axonframe.operators import geometry, partners, welding
from axonframe.sources import scene
from axonframe.sources.keyed import KeyedTable


def brute_pairs(rows, least):
    vectors = defaultdict(Counter)
    for q, p, w in rows:
        if q is not None and p is not None and w:
            vectors[q][p] += w
    norm = {q: sum(w * w for w in v.values()) ** 0.5 for q, v in vectors.items()}
    out = {}
    for a in vectors:
        for b in vectors:
            if a < b and (dot := sum(w * vectors[b][p] for p, w in vectors[a].items())) / norm[a] / norm[b] >= least:
                out[a, b] = dot / norm[a] / norm[b]
    return out


@pytest.mark.parametrize("least, block", [(0.3, 1024), (0.7, 5), (0.95, 1), (1.0, 3)])
def test_nothing_is_missed_against_all_pairs(spark, least, block):
    rng = random.Random(int(least * 100))
    rows = []
    for q in range(90):
        like = rng.randrange(12)
        mine = {(like * 3 + i) % 30: rng.randrange(1, 9) for i in range(3)} if q % 3 else {like: 4, 77: 1}
        rows += [(q, p, float(w)) for p, w in mine.items()] + [(q, 99, float(rng.randrange(1, 3)))]  # 99 is in every profile
    rows += [(1000, 5, 0.0), (None, 5, 1.0), (1001, None, 1.0)]
    df = spark.createDataFrame(rows, "query long, partner long, w double").repartition(3)
    got = partners.similar_profiles(df, least, block).collect()
    want = brute_pairs(rows, least - 1e-12)
    assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(r["a"], r["b"]) for r in got} == set(want) and want
    assert all(r["cosine"] == pytest.approx(want[r["a"], r["b"]]) for r in got)


def test_similar_profiles_of_an_empty_table_and_bad_bounds(spark):
    none = spark.createDataFrame([], "query long, partner long, w double")
    assert partners.similar_profiles(none, 0.5).count() == 0
    for least in (0, -1, 1.1):
        with pytest.raises(ValueError):
            partners.similar_profiles(none, least)


def curved(seed=3, bend=60.0):
    rng = np.random.default_rng(seed)
    source = rng.uniform(0, 1000, (40, 3))
    return geometry.ThinPlateSpline.fit(source, source * [1.1, 0.9, 1.0] + 30 * np.sin(source / 200) + rng.normal(0, bend / 20, (40, 3)))


def test_a_curved_warp_is_inverted():
    warp, points = curved(), np.random.default_rng(5).uniform(-100, 1100, (500, 3))
    back = warp.inverse(1e-6)
    assert np.abs(back(warp(points)) - points).max() < 1e-3 and np.abs(warp(back(points)) - points).max() < 1e-5
    assert back(np.empty((0, 3))).shape == (0, 3)
    small = 1e-4 * np.eye(3)
    for p in points[:20]:
        plain = np.stack([(warp(p[None] + d) - warp(p[None] - d))[0] / 2e-4 for d in small], axis=1)
        assert np.allclose(warp.jacobian(p[None])[0], plain, atol=1e-6)


def test_points_that_no_point_leads_to_are_nan():
    flat = geometry.ThinPlateSpline(np.zeros((1, 3)), np.zeros((1, 3)), np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 0]]))
    got = flat.inverse()(np.array([[3.0, 4.0, 0.0], [3.0, 4.0, 1.0]]))
    assert np.allclose(got[0], [3, 4, 0]) and np.isnan(got[1]).all()


def test_one_stored_direction_mirrors_and_comes_back(spark, tmp_path):
    warp = curved()
    path = tmp_path / "registration.json"
    path.write_text(warp.to_json())
    loaded = scene.load_registration(spark, str(path))
    points = [(i, *map(float, p)) for i, p in enumerate(np.random.default_rng(1).uniform(200e3, 800e3, (30, 3)))]
    df = spark.createDataFrame(points, "i int, x double, y double, z double")
    once = geometry.mirror(df, "tps", "nm", loaded, axis_um=1100.0)
    twice = geometry.mirror(once.select("i", *(F.col(f"m_{a}").alias(a) for a in "xyz")), "tps", "nm", loaded, axis_um=1100.0)
    for r in twice.collect():
        assert np.allclose([r["m_x"], r["m_y"], r["m_z"]], points[r["i"]][1:], atol=1.0)  # nm
    with pytest.raises(ValueError):
        geometry.ThinPlateSpline.from_json('{"source": [[0, 0, 0]], "weights": [[0, 0]], "affine": [[0, 0, 0]]}')
    with pytest.raises(ValueError):
        geometry.mirror(df, "tps")


def cube_halves():
    """A cube of 2 x 1 x 1 in two fragments, each without the faces between them, and with corners of its own."""
    out = []
    for k in (0, 1):
        corners = [(x + k, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
        sides = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
        sides.pop(1 if k == 0 else 0)
        out.append((corners, [t for a, b, c, d in sides for t in ((a, b, c), (a, c, d))]))
    return out


def test_two_fragments_weld_to_a_closed_mesh(spark):
    shift = [0.0, 4e-4]
    halves = cube_halves()
    vertices = [(f"f{k}", i, x + shift[k], float(y), float(z)) for k, (corners, _) in enumerate(halves) for i, (x, y, z) in enumerate(corners)] + [("f0", 90, None, 0.0, 0.0)]
    faces = [(f"f{k}", i, list(t)) for k, (_, tri) in enumerate(halves) for i, t in enumerate(tri)] + [("f0", 50, [0, 0, 1]), ("f0", 51, [0, 1, 77]), ("f1", 52, [0, 1, 90])]
    v, f = welding.weld(spark.createDataFrame(vertices, "fragment string, vertex int, x double, y double, z double"), spark.createDataFrame(faces, "fragment string, face int, v array<int>"), 1e-3)
    points, rows = {r["index"]: (r["x"], r["y"], r["z"]) for r in v.collect()}, [r["v"] for r in f.collect()]
    assert sorted(points) == list(range(12)) and len(rows) == 20
    edges = Counter((t[i], t[(i + 1) % 3]) for t in rows for i in range(3))
    assert all(edges[b, a] == n == 1 for (a, b), n in edges.items())  # every edge is met once each way: closed
    mesh = geometry.Mesh(np.array([points[i] for i in range(12)]), np.array(rows))
    assert mesh.signed_distance(np.array([[1.0, 0.5, 0.5], [2.5, 0.5, 0.5]])).round(3).tolist() == [0.5, -0.5]


def test_vertices_meet_over_cell_borders_and_in_chains(spark):
    tol = 0.01
    xs = [0.0399, 0.0401, 1.0, 1.009, 1.018, 1.027, 5.0, -0.0001, -5.0]
    vertices = spark.createDataFrame([("a", i, x, 0.0, -0.0) for i, x in enumerate(xs)], "fragment string, vertex int, x double, y double, z double")
    none = spark.createDataFrame([], "fragment string, face int, v array<int>")
    v, f = welding.weld(vertices, none, tol)
    assert sorted(r["x"] for r in v.collect()) == [-5.0, -0.0001, 0.0399, 1.0, 5.0] and f.count() == 0
    assert welding.weld(vertices.limit(0), none)[0].count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain, star = [(i, i + 1) for i in range(100, 160)], [(200, i) for i in range(201, 240)]
    edges = chain + star + [(5, 5), (300, 290), (290, 310)]
    rng.shuffle(edges)
    got = {r["node"]: r["least"] for r in welding.linked(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 200 for i in range(200, 240)} | {290: 290, 300: 290, 310: 290}


def test_offsets_of_fragments(spark):
    rows = [(f"f{i:02d}", i % 5 + 1, [[0, i % 5]]) for i in range(40)]
    df = spark.createDataFrame(rows, "fragment string, n_vertices int, faces array<array<int>>").repartition(5)
    want, before = {}, 0
    for name, n, faces in rows:
        want[name] = [before + faces[0][0], before + faces[0][1]]
        before += n
    assert {r["fragment"]: r["v"] for r in welding.concat_meshes(df).collect()} == want


def test_an_update_writes_the_buckets_of_its_rows_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=16)
    with pytest.raises(ValueError):
        table.read()
    table.create(spark.range(500).select(F.col("id").alias("_id"), F.lit("a").alias("v"), (F.col("id") * 2).alias("w")))
    rows = spark.createDataFrame([(i, "b") for i in range(8)] + [(9000, "new"), (9001, "new")], "_id long, v string")
    touched = table.update(rows, append=True, token="first")
    assert 0 < len(touched) <= 10
    got = {r["_id"]: (r["v"], r["w"]) for r in table.read().collect()}
    assert len(got) == 502 and got[3] == ("b", 6) and got[9000] == ("new", None) and got[300] == ("a", 600)
    files = {b: set(spark.read.parquet(f"{tmp_path}/t/{f}").inputFiles()) for b, f in table._journal()[1]["files"].items()}
    assert sum(any("data/" in n for n in x) for x in files.values()) == 16
    assert table.update(rows.withColumn("v", F.lit("again")), token="first") == [] and table.read().where("v = 'again'").count() == 0
    assert table.update(rows.limit(0)) == []
    with pytest.raises(ValueError):
        table.update(rows.union(rows))
    with pytest.raises(ValueError):
        table.create(rows)


def test_a_killed_run_leaves_the_old_table_and_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    table.create(spark.createDataFrame([(1, "a"), (None, "n")], "_id long, v string"))
    rows = spark.createDataFrame([(1, "b"), (None, "m")], "_id long, v string")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_enter", killed)
        with pytest.raises(KeyboardInterrupt):
            table.update(rows)
    assert sorted((r["v"] for r in table.read().collect())) == ["a", "n"]
    table.update(rows)
    with pytest.raises(Exception, match="exist"):
        table._enter(1, {})
    assert table.read().where("_id = 1").first()["v"] == "b" and table.read().count() == 2


def test_a_profile_goes_once_to_each_block(spark, monkeypatch):
    """Dense profiles share most of their columns: they are shipped per pair of blocks, not per shared column of it, and without a bound no pair is shuffled."""
    shipped = []
    frame = type(spark.range(0))
    with_partitions = frame.repartition

    def counted(self, n, *cols):
        if "asks" in self.columns:
            shipped.append(self.count())
        return with_partitions(self, n, *cols)

    monkeypatch.setattr(frame, "repartition", counted)
    rng = random.Random(4)
    rows = [(q, p, float(rng.randrange(1, 6))) for q in range(60) for p in rng.sample(range(40), 35)]
    df = spark.createDataFrame(rows, "query long, partner long, w double")
    got = {(r["a"], r["b"]): r["cosine"] for r in partners.similar_profiles(df, 0.8, 20).collect()}
    want = brute_pairs(rows, 0.8 - 1e-12)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got) and 10 < len(got) < 1700
    assert shipped == [60 * 3]
    every = partners.cosine_similarity(df.withColumnRenamed("w", "weight"), block_rows=20)
    found = {(r["a"], r["b"]): r["cosine"] for r in every.collect()}
    want = brute_pairs(rows, -1)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in found)
    assert shipped == [60 * 3] * 2


def test_all_pairs_that_share_a_partner_and_no_others(spark):
    """Rare and common partners, text ids, opposite weights whose product is zero, blocks of a few rows."""
    rng = random.Random(8)
    rows = [(f"n{q:03d}", p, float(w)) for q in range(120) for p, w in {rng.randrange(150): rng.randrange(1, 5), rng.randrange(150): 2, 900 + q % 5: 1 if q % 2 else -1}.items()]
    rows += [("zero", 3, 1.0), ("zero", 4, 1.0), ("oppose", 3, 1.0), ("oppose", 4, -1.0), (None, 3, 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "query string, partner long, weight double").repartition(3)
    vectors = defaultdict(dict)
    for q, p, w in rows:
        if q is not None and p is not None:
            vectors[q][p] = w
    length = {q: sum(w * w for w in v.values()) ** 0.5 for q, v in vectors.items()}
    want = {(a, b): sum(w * vectors[b].get(p, 0) for p, w in vectors[a].items()) / length[a] / length[b] for a in vectors for b in vectors if a < b and vectors[a].keys() & vectors[b].keys()}
    for block in (7, 4096):
        got = partners.cosine_similarity(df, block_rows=block).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
        assert all(r["cosine"] == pytest.approx(want[r["a"], r["b"]]) for r in got)
    assert want["oppose", "zero"] == 0
    assert partners.cosine_similarity(df.limit(0)).count() == 0


@pytest.mark.parametrize("alike, many", [(1024, 18), (4, 90)])
def test_equal_profiles_go_as_one_and_all_their_pairs_come(spark, monkeypatch, tmp_path, alike, many):
    """Six profiles of 20 neurons each and one alone, whose partner none other has: rows shipped follow the profiles, pairs the neurons. A profile of many neurons goes in parts."""
    shipped = []
    frame = type(spark.range(0))
    with_partitions = frame.repartition

    def counted(self, n, *cols):
        if "asks" in self.columns:
            shipped.append(self.count())
        return with_partitions(self, n, *cols)

    monkeypatch.setattr(frame, "repartition", counted)
    monkeypatch.setattr(partners, "ALIKE", alike, raising=False)
    rng = random.Random(6)
    kinds = [{p: float(rng.randrange(1, 6)) for p in rng.sample(range(8), 4 + k % 3)} | {50: 1.0} for k in range(5)] + [{70: 2.0}]
    names = [(f"n{rng.random():.6f}{k}", kind) for k, kind in enumerate(kinds) for _ in range(20)]
    rows = [(name, p, w) for name, kind in names for p, w in kind.items()] + [("alone", 90, 1.0)]
    df = spark.createDataFrame(rows, "query string, partner long, weight double").repartition(3)
    vectors = defaultdict(dict)
    for q, p, w in rows:
        vectors[q][p] = w
    for least in (None, 0.9):
        want = {k: v for k, v in brute_pairs(rows, least or -1).items() if vectors[k[0]].keys() & vectors[k[1]].keys()}
        got = (partners.cosine_similarity(df, block_rows=41) if least is None else partners.similar_profiles(df.withColumnRenamed("weight", "w"), least, 41)).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want) and len(want) >= 6 * 190
        assert all(r["cosine"] == pytest.approx(want[r["a"], r["b"]]) for r in got)
    assert all(n <= many for n in shipped) and len(shipped) == 2


def test_rows_of_a_summary_may_repeat_and_what_is_read_twice_is_deleted(spark, monkeypatch):
    stored, left = partners.stored, []

    def kept_at(df, name):
        table = stored(df, name)
        left.append((name, os.path.dirname(table.inputFiles()[0].removeprefix("file:").replace("///", "/"))))
        return table

    monkeypatch.setattr(partners, "stored", kept_at)
    rows = [(q, (q * 7 + i) % 11, 1) for q in range(30) for i in range(9) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "query long, partner long, weight int")
    once = df.groupBy("query", "partner").agg(F.sum("weight").alias("weight"))
    groups = spark.createDataFrame([(p, p % 4 if p else None) for p in range(11)], "partner long, group long")
    got = {(r["a"], r["b"]): r["cosine"] for r in partners.cosine_similarity(df, groups).collect()}
    want = {(r["a"], r["b"]): r["cosine"] for r in partners.cosine_similarity(once, groups).collect()}
    assert got == want and len(got) == 435
    kept = Counter(name for name, folder in left if os.path.exists(folder))
    assert set(kept) == {"profiles"} and len(left) > kept["profiles"]


@pytest.mark.parametrize("neurons, profiles, most", [(1500, 1500, {"a": 0.2, "b": 0.4, "cosine": 3.0}), (1500, 30, {"a": 0.2, "b": 0.4, "cosine": 0.4})])
def test_pairs_come_in_an_order_whose_parquet_is_small(spark, tmp_path, neurons, profiles, most):
    """Bytes a pair of each column, of neurons that all differ and of equal ones; all pairs are there, with Spark's rounding."""
    rng = np.random.default_rng(7)
    kinds = rng.poisson(25, (profiles, 24)) + 1
    rows = [(q * 7919 % 1000003, p, int(w)) for q in range(neurons) for p, w in enumerate(kinds[q % profiles])]
    df = spark.createDataFrame(rows, "query long, partner long, weight long")
    partners.cosine_similarity(df, digits=6).coalesce(1).write.parquet(str(tmp_path / "pairs"))
    size, n = Counter(), 0
    for name in (tmp_path / "pairs").glob("*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for group in map(meta.row_group, range(meta.num_row_groups)):
            n += group.num_rows
            for c in map(group.column, range(3)):
                size[c.path_in_schema] += c.total_compressed_size
    assert n == neurons * (neurons - 1) // 2
    assert all(size[c] <= most[c] * n for c in most), {c: size[c] / n for c in most}
    got = pq.read_table(tmp_path / "pairs").to_pandas()
    assert (got["a"] < got["b"]).all() and not got.duplicated(["a", "b"]).any()
    plain = partners.cosine_similarity(df).withColumn("cosine", F.round("cosine", 6)).toPandas()
    assert got.sort_values(["a", "b"]).reset_index(drop=True).equals(plain.sort_values(["a", "b"]).reset_index(drop=True))


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(3)
    half = (rng.integers(0, 10**6, 2000) + 0.5) / 10**6
    values = np.concatenate([rng.uniform(-1, 1, 2000), half, -half, np.nextafter(half, 0), np.nextafter(half, 2), [0.0, -1e-9, 1e-9, 1.0, -1.0, 5e-7, -5e-7]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    want = np.array([r[0] for r in df.select(F.round("v", 6), "i").orderBy("i").collect()])
    assert np.array_equal(partners._rounded(values, 6), want) and np.isnan(partners._rounded(np.array([np.nan]), 6)).all()


@pytest.mark.parametrize("rest", [4, 30, 4096])
def test_rectangles_hold_each_pair_once(monkeypatch, rest):
    monkeypatch.setattr(partners, "REST", rest)
    rng = np.random.default_rng(rest)
    for one, other in ((40, 60), (1, 90), (70, 1), (0, 5), (3, 3)):
        ranks = rng.permutation(one + other)
        for a, b in ((np.sort(ranks[:one]), np.sort(ranks[one:])), (np.sort(ranks[:one]), np.arange(one + other)), (np.arange(other), np.arange(other))):
            met = Counter()
            for x, y, order in partners._rectangles(a, b):
                assert x[-1] < y[0] if order > 0 else y[-1] < x[0] if order else len(x) * len(y) <= rest
                met.update((int(i), int(j)) for i in x for j in y)
            assert met == Counter((int(i), int(j)) for i in a for j in b)
