"""Nuclei, one or all per neuron."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import require_columns
from axonframe.functions.coords import format_xyz, parse_xyz
from axonframe.operators.ranks import ranked


def dedup_nuclei(nuclei: DataFrame, keep: str = "largest") -> DataFrame:
    """root_id, position, source, n_nuclei, nucleus_id: nuclei at one position count once, the largest (then the least id) for the rest.

    n_nuclei counts the different positions of a root before the cut to the largest. Rows without root or with an
    incomplete position are left out. Positions merge by partial aggregation; with keep="all" a root's positions are ranked over range partitions, never in one task.
    """
    if keep not in ("largest", "all"):
        raise ValueError("keep must be largest or all")
    require_columns(nuclei, "id", "pt_root_id", "pt_position", "volume")
    rows = nuclei.select(F.col("pt_root_id").alias("root_id"), parse_xyz(F.col("pt_position").cast("string")).alias("p"), F.col("volume").cast("double").alias("volume"), "id").where("root_id IS NOT NULL AND p IS NOT NULL")
    order = F.struct(F.coalesce("volume", F.lit(float("-inf"))).alias("v"), (-F.col("id")).alias("i"))
    places = rows.groupBy("root_id", "p").agg(F.max(order).alias("top"))
    shaped = places.select("root_id", format_xyz(F.col("p.x"), F.col("p.y"), F.col("p.z")).alias("position"), F.col("top.v").alias("v"), (-F.col("top.i")).alias("nucleus_id"))
    if keep == "largest":
        best = F.max_by(F.struct("position", "nucleus_id"), F.struct("v", -F.col("nucleus_id"))).alias("b")
        return shaped.groupBy("root_id").agg(best, F.count(F.lit(1)).alias("n_nuclei")).select("root_id", F.col("b.position").alias("position"), F.lit("nucleus").alias("source"), F.col("n_nuclei").cast("int").alias("n_nuclei"), F.col("b.nucleus_id").alias("nucleus_id"))
    out = ranked(shaped, "root_id", F.desc("v"), F.asc("nucleus_id"), rank="size_rank", size="n_nuclei")
    return out.select("root_id", "position", F.lit("nucleus").alias("source"), F.col("n_nuclei").cast("int").alias("n_nuclei"), "nucleus_id", F.col("size_rank").cast("int").alias("size_rank"))
