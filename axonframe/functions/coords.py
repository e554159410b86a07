"""Voxel and nanometre coordinates, and their text form "x,y,z"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import is_finite, number_text

#: Nanometres per voxel along x, y and z (fixed values of the dataset).
VOXEL_NM = (16.0, 16.0, 45.0)
AXES = ("x", "y", "z")


def _axes(prefix: str) -> list[str]:
    return [prefix + a for a in AXES]


def raw_to_nm(df: DataFrame, voxel=VOXEL_NM, prefix: str = "") -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(float(v)) for c, v in zip(_axes(prefix), voxel)})


def nm_to_raw(df: DataFrame, voxel=VOXEL_NM, prefix: str = "") -> DataFrame:
    """The inverse of raw_to_nm; nothing is rounded."""
    return df.withColumns({c: F.col(c) / F.lit(float(v)) for c, v in zip(_axes(prefix), voxel)})


def parse_xyz(text: Column) -> Column:
    """struct<x, y, z: double> from three numbers separated by commas, white space or both; null for anything else."""
    parts = F.split(F.trim(text), r"[,\s]+")
    get = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    ok = (F.size(parts) == 3) & get(1).isNotNull() & get(2).isNotNull() & get(3).isNotNull()
    return F.when(ok, F.struct(get(1).alias("x"), get(2).alias("y"), get(3).alias("z")))


def format_xyz(x: Column, y: Column, z: Column, sep: str = ",") -> Column:
    """Text of three numbers, whole ones without a fraction; null if one is null."""
    return F.concat_ws(sep, *map(number_text, (x, y, z))) if sep is None else F.concat(number_text(x), F.lit(sep), number_text(y), F.lit(sep), number_text(z))


def complete_xyz(prefix: str = "") -> Column:
    x, y, z = (is_finite(F.col(c)) for c in _axes(prefix))
    return x & y & z


def convert_units(df: DataFrame, units: str, voxel=VOXEL_NM) -> DataFrame:
    """Nanometre skeleton nodes in units nm, raw or microns; radii stay as they are."""
    if units == "nm":
        return df
    if units == "raw":
        return nm_to_raw(df, voxel)
    if units == "microns":
        return nm_to_raw(df, (1000.0,) * 3)
    raise ValueError(f"units must be nm, raw or microns, not {units!r}")


def squared_distance(prefix_a: str = "", prefix_b: str = "p") -> Column:
    out = None
    for a in AXES:
        d = F.col(prefix_a + a) - F.col(prefix_b + a)
        out = d * d if out is None else out + d * d
    return out
