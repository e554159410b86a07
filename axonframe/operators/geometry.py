"""Mirroring, sides, nearest points and signed distances to a closed mesh."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import is_finite, require_columns
from axonframe.functions.coords import VOXEL_NM, squared_distance
from axonframe.operators.surface import BoxTree

#: Nanometres per unit of length that the callers know.
UNIT_NM = {"nm": 1.0, "microns": 1000.0}


@dataclass
class ThinPlateSpline:
    """A 3-D thin-plate spline with kernel r and an affine part, fitted on landmark pairs (few, on the driver)."""

    source: np.ndarray
    weights: np.ndarray
    affine: np.ndarray

    @classmethod
    def fit(cls, source, target) -> ThinPlateSpline:
        source, target = np.asarray(source, float), np.asarray(target, float)
        if source.shape != target.shape or source.ndim != 2 or source.shape[1] != 3:
            raise ValueError("landmarks need pointA and pointB of the same number, three coordinates each")
        n = len(source)
        kernel = np.linalg.norm(source[:, None] - source[None], axis=2)
        poly = np.column_stack([np.ones(n), source])
        system = np.block([[kernel, poly], [poly.T, np.zeros((4, 4))]])
        solved = np.linalg.lstsq(system, np.vstack([target, np.zeros((4, 3))]), rcond=None)[0]
        return cls(source, solved[:n], solved[n:])

    def __call__(self, points: np.ndarray) -> np.ndarray:
        r = np.linalg.norm(points[:, None] - self.source[None], axis=2)
        return r @ self.weights + np.column_stack([np.ones(len(points)), points]) @ self.affine

    def jacobian(self, points: np.ndarray) -> np.ndarray:
        """The derivative at each point: 3 x 3, a row for each coordinate that comes out."""
        gap = points[:, None] - self.source[None]
        r = np.linalg.norm(gap, axis=2)
        unit = gap / np.where(r > 0, r, 1)[:, :, None]
        return np.einsum("ijk,jl->ilk", unit, self.weights) + self.affine[1:].T[None]

    def inverse(self, tolerance: float = 1e-6, steps: int = 60) -> InverseSpline:
        return InverseSpline(self, tolerance, steps)

    def to_json(self) -> str:
        return json.dumps({k: np.asarray(v).tolist() for k, v in (("source", self.source), ("weights", self.weights), ("affine", self.affine))})

    @classmethod
    def from_json(cls, text: str) -> ThinPlateSpline:
        """From stored coefficients: source points (n x 3), their weights (n x 3), and the affine part (4 x 3, the constant first)."""
        raw = json.loads(text)
        spline = cls(*(np.asarray(raw[k], float) for k in ("source", "weights", "affine")))
        if spline.source.ndim != 2 or spline.source.shape[1] != 3 or spline.weights.shape != spline.source.shape or spline.affine.shape != (4, 3):
            raise ValueError("a spline has source points and weights of the same number, three coordinates each, and an affine part of four rows")
        return spline


@dataclass
class InverseSpline:
    """Where a spline takes points from, by damped Newton steps for all points at once: a step is halved until it brings the point nearer. Points that do not come within the tolerance (in the spline's units) are NaN."""

    forward: ThinPlateSpline
    tolerance: float = 1e-6
    steps: int = 60

    def __call__(self, points: np.ndarray) -> np.ndarray:
        target = np.asarray(points, float)
        linear = np.linalg.pinv(self.forward.affine[1:])
        x = (target - self.forward.affine[0]) @ linear
        miss = target - self.forward(x) if len(x) else target
        for _ in range(self.steps):
            size = np.linalg.norm(miss, axis=1)
            open_ = np.flatnonzero(size > self.tolerance)
            if not len(open_):
                break
            step = (np.linalg.pinv(self.forward.jacobian(x[open_])) @ miss[open_][:, :, None])[:, :, 0]
            share = np.ones(len(open_))
            left = np.arange(len(open_))
            for _ in range(20):
                tried = x[open_[left]] + share[left, None] * step[left]
                now = target[open_[left]] - self.forward(tried)
                nearer = np.linalg.norm(now, axis=1) < size[open_[left]]
                x[open_[left[nearer]]], miss[open_[left[nearer]]] = tried[nearer], now[nearer]
                left = left[~nearer]
                if not len(left):
                    break
                share[left] /= 2
        return np.where((np.linalg.norm(miss, axis=1) <= self.tolerance)[:, None], x, np.nan) if len(x) else x


def mirror_landmarks(point_a, point_b, raw: bool = True, units: str = "nm", voxel=VOXEL_NM) -> ThinPlateSpline:
    """The spline that swaps the sides: fitted on A over B to B over A. Raw landmarks are voxels; else they are in `units`."""
    if point_a is None or point_b is None or len(point_a) != len(point_b):
        raise ValueError("landmarks need pointA and pointB of the same number")
    scale = np.asarray(voxel, float) / UNIT_NM[units] if raw else 1.0
    a, b = np.asarray(point_a, float) * scale, np.asarray(point_b, float) * scale
    return ThinPlateSpline.fit(np.vstack([a, b]), np.vstack([b, a]))


def apply_to_points(df: DataFrame, f, prefix: str = "", out: str = "m") -> DataFrame:
    """Adds out_x, out_y, out_z: f of the finite points, in Arrow batches; null for others."""

    @F.pandas_udf("x double, y double, z double")
    def moved(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        points = np.column_stack([x, y, z]).astype(float)
        good = np.isfinite(points).all(axis=1)
        result = np.full(points.shape, np.nan)
        if good.any():
            result[good] = f(points[good])
        return pd.DataFrame(result, columns=["x", "y", "z"])

    cols = [F.col(prefix + a).cast("double") for a in "xyz"]
    df = df.withColumn("__m", moved(*cols))
    return df.withColumns({f"{out}_{a}": F.nanvl(F.col("__m")[a], F.lit(None).cast("double")) for a in "xyz"}).drop("__m")


def mirror(df: DataFrame, method: str = "tps", units: str = "nm", to_symmetric: ThinPlateSpline | None = None, back: ThinPlateSpline | InverseSpline | None = None, swap: ThinPlateSpline | None = None, axis_um: float = 734.144, prefix: str = "", out: str = "m") -> DataFrame:
    """Adds the mirrored point. tps (or symmetric): to the symmetric space in µm, flipped along x of length axis_um, and back, by the spline that is given for it or else by inverting the first (to 1e-6 µm); landmarks: one spline that swaps the sides."""
    if method == "landmarks":
        if swap is None:
            raise ValueError("method landmarks needs the spline of mirror_landmarks")
        return apply_to_points(df, swap, prefix, out)
    if method not in ("tps", "symmetric"):
        raise ValueError(f"unknown method {method!r}")
    if to_symmetric is None:
        raise ValueError("method tps needs the registration")
    scale = UNIT_NM[units] / 1000.0
    back = back or to_symmetric.inverse()

    def flip(points: np.ndarray) -> np.ndarray:
        moved = to_symmetric(points * scale)
        moved[:, 0] = axis_um - moved[:, 0]
        return back(moved) / scale

    return apply_to_points(df, flip, prefix, out)


def side_distance(x: Column, mirrored_x: Column) -> Column:
    """Half of how far the mirrored point lies along x: negative on the left; null unless both are finite."""
    return F.when(is_finite(x) & is_finite(mirrored_x), (mirrored_x - x) / 2)


def side_of(distance: Column, threshold: float = 5000) -> Column:
    """L below zero, else R; M where the distance is below a threshold above zero."""
    if not np.isscalar(threshold) or not np.isfinite(threshold) or threshold < 0:
        raise ValueError("threshold must be one finite number of zero or more")
    side = F.when(distance < 0, "L").when(distance >= 0, "R")
    return F.when(F.abs(distance) < threshold, "M").otherwise(side) if threshold > 0 else side


def nearest_rows(points: DataFrame, nodes: DataFrame, key: str = "root_id", tie: str = "node_id") -> DataFrame:
    """For each key's point (px, py, pz) its nearest node row, ties to the least `tie`: an equi join and a min_by, combined before the shuffle."""
    require_columns(points, key, "px", "py", "pz")
    rows = nodes.join(points.select(F.col(key).alias("__k"), "px", "py", "pz"), F.col(key) == F.col("__k"))
    rest = [c for c in nodes.columns if c != key]
    best = rows.withColumn("__d", squared_distance()).where("__d IS NOT NULL").groupBy(key).agg(F.min_by(F.struct(*rest, F.col("__d").alias("d2")), F.struct("__d", tie)).alias("__r"))
    return best.select(key, *[F.col("__r")[c].alias(c) for c in rest], F.col("__r")["d2"].alias("d2"))


@dataclass
class Mesh:
    """A closed triangle mesh; its size is that of one brain region, whatever the size of the tables. Its tree of boxes is built once, on first use, and goes to the tasks with it."""

    vertices: np.ndarray
    faces: np.ndarray

    def __post_init__(self):
        if not len(self.faces):
            raise ValueError("a mesh needs faces")

    @cached_property
    def tree(self) -> BoxTree:
        return BoxTree.build(self.vertices, self.faces)

    def signed_distance(self, points: np.ndarray) -> np.ndarray:
        """Distance to the surface, negative outside; of any closed shape, convex or not."""
        return self.tree.signed_distance(points)


def mesh_distance(df: DataFrame, mesh: Mesh, prefix: str = "", out: str = "dist_npil_nm") -> DataFrame:
    """Adds the signed distance of each point to the mesh (negative outside), null for points that are not finite."""
    tree = mesh.tree

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        points = np.column_stack([x, y, z]).astype(float)
        good = np.isfinite(points).all(axis=1)
        result = np.full(len(points), np.nan)
        if good.any():
            result[good] = tree.signed_distance(points[good])
        return pd.Series(result)

    value = distance(*[F.col(prefix + a).cast("double") for a in "xyz"])
    return df.withColumn(out, F.nanvl(value, F.lit(None).cast("double")))


def surface_label(distance_nm: Column) -> Column:
    return F.when(distance_nm > 0, "inside").when(distance_nm < 0, "outside").when(distance_nm == 0, "surface")
