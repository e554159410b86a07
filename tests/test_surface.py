"""The tree of boxes against every point with every triangle."""

import numpy as np
import pytest

from axonframe.operators import geometry
from axonframe.operators.surface import BoxTree, solid_angle, triangle_distance2


def ring(n, m, bump=200.0):
    """A bumpy ring of 2 n m triangles: closed, and far from convex."""
    u, v = np.meshgrid(np.arange(n) * 2 * np.pi / n, np.arange(m) * 2 * np.pi / m, indexing="ij")
    r = 1000 + bump * np.sin(5 * u) * np.cos(3 * v)
    xyz = np.stack([(3000 + r * np.cos(v)) * np.cos(u), (3000 + r * np.cos(v)) * np.sin(u), r * np.sin(v)], axis=-1).reshape(-1, 3)
    i, j = np.arange(n)[:, None], np.arange(m)[None]
    a, b, c, d = (x % n * m + y % m for x, y in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)))
    return xyz, np.concatenate([np.stack(t, axis=-1).reshape(-1, 3) for t in ((a, b, c), (a, c, d))])


def plain(vertices, faces, points):
    a, b, c = (vertices[faces[:, k]] for k in range(3))
    out = []
    for p in points:
        q = np.broadcast_to(p, a.shape)
        out.append(np.sqrt(triangle_distance2(q, a, b, c).min()) * (1 if abs(solid_angle(q, a, b, c).sum()) > 2 * np.pi else -1))
    return np.array(out)


def test_ten_thousand_faces_with_few_triangle_tests():
    vertices, faces = ring(100, 50)
    rng = np.random.default_rng(3)
    points = np.vstack([rng.uniform(-4500, 4500, (250, 3)) * [1, 1, 0.3], vertices[:100] + rng.normal(0, 40, (100, 3)), [[0, 0, 0], [3000, 0, 0], [1e7, 0, 0]]])
    tree = BoxTree.build(vertices, faces)
    got = tree.signed_distance(points)
    assert np.allclose(got, plain(vertices, faces, points), atol=1e-6)
    assert len(faces) == 10_000 and tree.tests < 0.02 * len(points) * len(faces)
    assert (got > 0).sum() > 50 and (got < 0).sum() > 50


@pytest.mark.parametrize("shape", [(3, 3), (5, 4), (9, 7)])
def test_small_meshes_and_points_on_the_surface(shape):
    vertices, faces = ring(*shape, bump=0.0)
    points = np.random.default_rng(1).uniform(-4500, 4500, (200, 3))
    tree = BoxTree.build(vertices, faces)
    assert np.allclose(tree.signed_distance(points), plain(vertices, faces, points), atol=1e-6)
    assert np.allclose(tree.signed_distance(vertices), 0, atol=1e-6)
    one = BoxTree.build(vertices, faces[:1])  # an open surface has distances, and nothing inside
    assert (one.signed_distance(points) < 0).all()
    assert tree.signed_distance(np.empty((0, 3))).shape == (0,)


def test_a_mesh_without_faces_is_an_error():
    with pytest.raises(ValueError):
        geometry.Mesh(np.zeros((3, 3)), np.empty((0, 3), int))


def test_points_that_are_not_finite_have_no_distance(spark):
    vertices, faces = ring(9, 7)
    df = spark.createDataFrame([(1, 3000.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, float("inf"), 0.0, 0.0)], "i int, x double, y double, z double")
    got = {r["i"]: r["dist_npil_nm"] for r in geometry.mesh_distance(df, geometry.Mesh(vertices, faces)).collect()}
    assert got[1] > 0 and got[2] is got[3] is got[4] is None
