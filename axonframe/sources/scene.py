"""Viewer scenes: datasets, point and line annotations, movie layers."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators.geometry import ThinPlateSpline

LAYERS = "layers array<struct<type:string, name:string, source:string, annotations:array<struct<id:string, type:string, point:array<double>, pointA:array<double>, pointB:array<double>>>>>"


@dataclass(frozen=True)
class DatasetConfig:
    """Which dataset queries mean by default."""

    datastack: str
    scene_url: str | None = None
    voxel: tuple[float, float, float] = (16.0, 16.0, 45.0)

    @classmethod
    def from_scene(cls, scene: str | dict, url: str | None = None) -> DatasetConfig:
        """From the first segmentation layer; the datastack is the last part of its source."""
        scene = json.loads(scene) if isinstance(scene, str) else scene
        for layer in scene.get("layers", []):
            if str(layer.get("type", "")).startswith("segmentation"):
                source = layer["source"]
                source = source["url"] if isinstance(source, dict) else source
                return cls(source.rstrip("/").rsplit("/", 1)[-1], url)
        raise ValueError("the scene has no segmentation layer")


def scene_annotations(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(layer, id, type, point, pointA, pointB) of all annotations of JSON scenes, one scene per file."""
    rows = spark.read.schema(LAYERS).option("multiLine", True).json(path).select(F.explode("layers").alias("l")).select(F.col("l.name").alias("layer"), F.explode("l.annotations").alias("a")).select("layer", "a.*")
    return rows.where(F.col("type") == kind) if kind else rows


def landmark_pairs(annotations: DataFrame) -> tuple[list, list]:
    """The two ends of line annotations, in order of id: landmarks are tens of points."""
    rows = annotations.where("pointA IS NOT NULL AND pointB IS NOT NULL").orderBy("id").select("pointA", "pointB").collect()
    return [r.pointA for r in rows], [r.pointB for r in rows]


def load_registration(spark: SparkSession, path: str) -> ThinPlateSpline:
    """A registration stored as one JSON document of spline coefficients, from any store that Spark reads; its inverse() goes the other way, so that one direction is enough."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} has to be one document")
    return ThinPlateSpline.from_json(rows[0][0])


def annotation_layer(df: DataFrame, prefix: str = "soma: ") -> DataFrame:
    """(point, segments, layer) of rows with a position; a layer for each source."""
    return df.where("position IS NOT NULL").select(F.col("position").alias("point"), F.col("root_id").cast("string").alias("segments"), F.concat(F.lit(prefix), F.coalesce("source", F.lit("NA"))).alias("layer"))
