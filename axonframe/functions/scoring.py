"""Column expressions of the soma score."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from axonframe.functions.columns import is_finite

FEATURES = ("log_area", "log_size", "log_max_dt", "log_mean_dt", "roundness")
TINY = 2.2250738585072014e-308


@dataclass
class SomaModel:
    """Mean and inverse covariance of the features of known somata, and the density of their distance from the neuropil (uniform grid, µm)."""

    mean: list[float]
    inverse_covariance: list[list[float]]
    support: tuple[float, float] = (-200.0, 50.0)
    density: list[float] = field(default_factory=list)
    uniform_eps: float = 0.001
    weight: float = 1.0
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def floor_density(self) -> float:
        return self.uniform_eps / (self.support[1] - self.support[0])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> SomaModel:
        raw = json.loads(text)
        raw["support"] = tuple(raw["support"])
        return cls(**raw)


def chunk_features() -> dict[str, Column]:
    """log1p of sizes (negative ones as zero, null stays null) and the ratio of the third to the first principal value."""
    log = lambda c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0))))
    sizes = dict(zip(FEATURES, map(log, ("area_nm2", "size_nm3", "max_dt_nm", "mean_dt_nm"))))
    return sizes | {"roundness": F.when(F.col("pca_val_0") > 0, F.col("pca_val_2") / F.col("pca_val_0"))}


def mahalanobis(model: SomaModel) -> Column:
    """Squared Mahalanobis distance of the features; null unless finite."""
    total = F.lit(0.0)
    for i, a in enumerate(FEATURES):
        for j, b in enumerate(FEATURES):
            total = total + (F.col(a) - model.mean[i]) * (F.col(b) - model.mean[j]) * model.inverse_covariance[i][j]
    return F.when(is_finite(total), total)


def density_at(model: SomaModel, distance_um: Column) -> Column:
    """Linear interpolation on the uniform grid; the floor density outside of it and for null."""
    lo, hi = model.support
    n, step = len(model.density), (hi - lo) / (len(model.density) - 1)
    grid = F.array(*map(F.lit, map(float, model.density)))
    at = (distance_um - lo) / step
    i = F.least(F.floor(at).cast("int"), F.lit(n - 2))
    left, right = F.try_element_at(grid, i + 1), F.try_element_at(grid, i + 2)
    inside = is_finite(distance_um) & (distance_um >= lo) & (distance_um <= hi)
    return F.when(inside, left + (right - left) * (at - i)).otherwise(model.floor_density)


def distance_penalty(model: SomaModel, distance_um: Column) -> Column:
    """-2 ln(density / greatest density)."""
    return -2 * F.log(F.greatest(density_at(model, distance_um), F.lit(TINY)) / max(model.density))


def gaussian_kde_constant(n: int, bandwidth: float) -> float:
    return 1 / (n * bandwidth * math.sqrt(2 * math.pi))
