"""Fitting the soma score: examples, moments, quantiles and the density of distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.columns import map_suffix
from axonframe.functions.coords import parse_xyz
from axonframe.functions.shared import fresh
from axonframe.functions.scoring import FEATURES, SomaModel, chunk_features
from axonframe.operators import ranks
from axonframe.operators.geometry import Mesh, mesh_distance, nearest_rows, surface_label
from axonframe.operators.lookup import points_to_segments

QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def positives(chunks: DataFrame, somata: DataFrame) -> DataFrame:
    """Each root's chunk nearest to its recorded soma: chunks(root_id, l2_id, rep_coord_nm_*), somata(root_id, px, py, pz)."""
    named = chunks.withColumnsRenamed({f"rep_coord_nm_{a}": a for a in "xyz"})
    return nearest_rows(somata, named, tie="l2_id").withColumnsRenamed({a: f"rep_coord_nm_{a}" for a in "xyz"})


def hard_negatives(chunks: DataFrame, points: DataFrame, cells: DataFrame, cell=(1.0, 1.0, 1.0), history: DataFrame | None = None, at=None) -> DataFrame:
    """The chunk nearest to each curated bad point(x, y, z raw) of the root that holds the point now; points in no segment are dropped."""
    held = points_to_segments(points, cells, cell, raw=True, history=history, at=at, integer=True).where("segment_id <> 0")
    targets = held.groupBy(F.col("segment_id").alias("root_id")).agg(F.min(F.struct("x", "y", "z")).alias("p")).select("root_id", *[F.col("p")[a].alias(f"p{a}") for a in "xyz"])
    return positives(chunks, targets)


def neuropil_distances(nuclei: DataFrame, mesh: Mesh, position: str = "pt_position") -> DataFrame:
    """nuclei with dist_um (negative outside) and where (inside, outside, surface) of their positions; all *position columns as text."""
    p = parse_xyz(F.col(position).cast("string"))
    rows = mesh_distance(nuclei.select("*", *[p[a].alias(f"__{a}") for a in "xyz"]), mesh, "__", "__d").drop("__x", "__y", "__z")
    out = rows.withColumns({"dist_um": F.col("__d") / 1000, "where": surface_label(F.col("__d"))}).drop("__d")
    return map_suffix(out, "position", lambda c: c.cast("string"))


def soft_negatives(chunks: DataFrame, per_root: int = 10, seed: int = 20260524) -> DataFrame:
    """Up to per_root chunks of each root, those with the least seeded digests of their ids (then the least ids): the same rows on every run. This sample is the operator's purpose.

    Every task keeps per_root rows of each root before any are shuffled, so that a root of very many chunks brings few.
    """
    place = fresh("place", chunks)
    drawn = F.sha2(F.concat(F.col("l2_id").cast("string"), F.lit(f":{seed}")), 256)
    order = Window.partitionBy("root_id").orderBy(drawn.asc_nulls_last(), "l2_id")
    return chunks.withColumn(place, F.row_number().over(order)).where(F.col(place) <= per_root).drop(place)


def examples(positive: DataFrame, *negative: DataFrame) -> DataFrame:
    """(root_id, l2_id, features.., label) of rows with all features."""
    features = chunk_features()
    parts = [df.select("root_id", "l2_id", *[c.alias(n) for n, c in features.items()], F.lit(y).alias("label")) for df, y in ((positive, 1), *((d, 0) for d in negative))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropna(subset=list(FEATURES))


def moments(df: DataFrame, features=FEATURES) -> DataFrame:
    """One row: means and sample covariances, in one aggregate."""
    covariances = [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(features) for b in features[i:]]
    return df.agg(*[F.avg(f).alias(f"mean_{f}") for f in features], *covariances, F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, features=FEATURES, at=QUANTILES) -> DataFrame:
    """One row: exact quantiles with linear interpolation, an array for each feature; no task holds a whole column."""
    return ranks.quantiles(df, features, at)


def bandwidth(n: int, sd: float | None, iqr: float | None, first: float = 1.0) -> float:
    """0.9 min(sd, IQR / 1.34) n ** -1/5; where the lesser is zero the sd counts, then the size of a value, then one."""
    low = min(sd or 0.0, (iqr or 0.0) / 1.34) or sd or abs(first) or 1.0
    return 0.9 * low * n**-0.2


#: Bins to one bandwidth. With four bins for each value, the estimate differs from the plain sum by some 1e-10 of its height.
BINS_A_WIDTH = 256
#: More bins than these make no estimate: the width is then a ten-thousandth of the support.
MOST_BINS = 1 << 23


def kde(df: DataFrame, column: str, support=(-200.0, 50.0), points: int = 1024, width: float | None = None) -> DataFrame:
    """(at, density) of a Gaussian kernel estimate on a uniform grid over the support, of values within it.

    Values are binned by an aggregate: a bin's count and sums of its values' places within it, of first to third power,
    spread them over the four nearest grid places as cubic interpolation does. The bins, whose number depends on the
    support and the width alone, are folded with the kernel by one Fourier transform, and read off at the points. Time
    grows with the rows, not with rows times points. Without a width the bandwidth rule takes the standard deviation and
    exact quartiles. Without values the density is null.
    """
    lo, hi = map(float, support)
    rows = df.where(F.col(column).between(lo, hi)).select(F.col(column).cast("double").alias("v")).where(~F.isnan("v"))
    if width is None:
        n, sd, some = rows.agg(F.count("v"), F.stddev_samp("v"), F.min("v")).first()
        quart = ranks.quantiles(rows, ["v"], [0.25, 0.75]).first()["v"]
        width = bandwidth(n, sd, quart[1] - quart[0], some) if n else 1.0
    step = width / BINS_A_WIDTH
    lead = BINS_A_WIDTH * 8  # the kernel ends at eight widths
    size = 1 << int(np.ceil(np.log2((hi - lo) / step + 2 * lead + 4)))
    place = (F.col("v") - lo) / step
    f = place - F.floor(place)
    if size > MOST_BINS:
        raise ValueError("the width is too small for the support")
    binned = rows.groupBy((F.floor(place) + lead).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f**k).alias(f"m{k}") for k in (1, 2, 3)))
    at = np.linspace(lo, hi, points)

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m1, m2, m3 = (pdf[c].to_numpy(float) for c in ("n", "m1", "m2", "m3"))
        mass = np.zeros(size)
        shares = (-m3 / 6 + m2 / 2 - m1 / 3, m3 / 2 - m2 - m1 / 2 + n, -m3 / 2 + m2 / 2 + m1, m3 / 6 - m1 / 6)
        for k, share in enumerate(shares):
            np.add.at(mass, pdf["bin"].to_numpy() + k - 1, share)
        away = np.minimum(np.arange(size), size - np.arange(size)) * step
        kernel = np.exp(-0.5 * (away / width) ** 2) / (n.sum() * width * np.sqrt(2 * np.pi))
        curve = np.fft.irfft(np.fft.rfft(mass) * np.fft.rfft(kernel), size)
        x = (at - lo) / step + lead
        i = np.minimum(np.floor(x).astype(np.int64), size - 3)
        t = x - i
        y = [curve[i + k] for k in (-1, 0, 1, 2)]
        return pd.DataFrame({"i": np.arange(points), "density": -t * (t - 1) * (t - 2) / 6 * y[0] + (t + 1) * (t - 1) * (t - 2) / 2 * y[1] - (t + 1) * t * (t - 2) / 2 * y[2] + (t + 1) * t * (t - 1) / 6 * y[3]})

    curve = binned.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(folded, "i int, density double")  # at most `size` bins, whatever the rows
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("of"), (F.lit(lo) + F.col("id") * (hi - lo) / (points - 1)).alias("at"))
    return grid.join(curve, F.col("of") == F.col("i"), "left").select("at", "density")


def mixed_density(estimate: DataFrame, support=(-200.0, 50.0), eps: float = 0.001) -> DataFrame:
    """The estimate mixed with a uniform density of share eps."""
    return estimate.select("at", ((1 - eps) * F.col("density") + eps / (support[1] - support[0])).alias("density"))


def fit_soma_model(positive: DataFrame, negative: DataFrame, distances_um: DataFrame, column: str, support=(-200.0, 50.0), points: int = 1024, eps: float = 0.001) -> SomaModel:
    """The model from the examples' moments and the distances' density; a few rows of a fixed number come to the driver."""
    rows = examples(positive, negative)
    m = moments(rows.where("label = 1")).first().asDict()
    cov = np.array([[m.get(f"cov_{a}_{b}", m.get(f"cov_{b}_{a}")) for b in FEATURES] for a in FEATURES])
    density = mixed_density(kde(distances_um, column, support, points), support, eps).orderBy("at").collect()
    counts = {("positive" if r["label"] else "negative"): r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return SomaModel([m[f"mean_{f}"] for f in FEATURES], np.linalg.pinv(cov).tolist(), support, [r["density"] for r in density], eps, counts=counts)
