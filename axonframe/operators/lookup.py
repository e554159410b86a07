"""From points to the segments that hold them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from axonframe.functions.chunks import morton
from axonframe.functions.columns import is_finite, require_columns
from axonframe.functions.coords import VOXEL_NM
from axonframe.functions.shared import fresh
from axonframe.operators.hierarchy import nodes_of_points
from axonframe.operators.versions import root_at


def points_to_segments(points: DataFrame, cells: DataFrame, cell=(1.0, 1.0, 1.0), raw: bool = False, voxel=VOXEL_NM, root: bool = True, history: DataFrame | None = None, at: Column | None = None, integer: bool = False, stop_layer: int | None = None, nodes: DataFrame | None = None, chunk_cells=(1, 1, 1)) -> DataFrame:
    """points(x, y, z, ..) with segment_id: the supervoxel of the point's grid cell, its root at a moment, or the node that holds it at a layer.

    cells(cx, cy, cz, supervoxel_id). Points in nm are divided by the voxel size first. A point with a missing coordinate
    is not looked up; it and points in no cell get zero. Every input row gives one row; ids are text unless integer.

    With nodes (of hierarchy.layer_nodes) stop_layer 1 is the supervoxel, 2 the level-2 chunk, None the root; chunk_cells
    says how many cells a chunk of layer 2 has along each axis. The node is found by layer, chunk and supervoxel, so that
    one join serves each layer; a supervoxel that the hierarchy lacks gives zero. Negative chunk coordinates count from
    the far end of space.
    """
    require_columns(cells, "cx", "cy", "cz", "supervoxel_id")
    if stop_layer is not None and (nodes is None or stop_layer < 1):
        raise ValueError("stop_layer is 1 or more, and needs the nodes of the hierarchy")
    scale = (1.0, 1.0, 1.0) if raw else voxel
    whole = is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))
    near = [fresh(f"c{a}", points, cells) for a in "xyz"]
    sv, found = fresh("sv", points, cells), fresh("found", points, cells)
    keys = [F.when(whole, F.floor(F.col(a) / (float(s) * float(c)))).cast("long").alias(n) for a, n, s, c in zip("xyz", near, scale, cell)]
    there = [fresh(f"of_{a}", points) for a in "xyz"]
    grid = cells.where("cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL").groupBy(*(F.col(f"c{a}").alias(n) for a, n in zip("xyz", there))).agg(F.min("supervoxel_id").alias(sv))
    # Null-safe, so that the cells are dealt anew: a join on the aggregate's own keys could not be split where a cell is hot.
    on = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(near, there)])
    joined = points.select("*", *keys).join(grid, on, "left").select(*points.columns, *near, sv)
    if root and nodes is not None:
        code, where = fresh("code", joined), morton(*(F.floor(F.col(n) / c) for n, c in zip(near, chunk_cells)))
        joined = nodes_of_points(joined.withColumn(code, where), nodes, stop_layer, code, sv, found)
    elif root and history is not None:
        joined = root_at(joined, history, at, supervoxel=sv, root=None, out=found)
    else:
        joined = joined.withColumn(found, F.col(sv))
    value = F.coalesce(F.col(found).cast("long"), F.lit(0))
    return joined.select(*[F.col(c) for c in points.columns if c != "segment_id"], (value if integer else value.cast("string")).alias("segment_id"))


@dataclass(frozen=True)
class Space:
    """How points find their level-2 chunks: the grid of supervoxels, the nodes above them (hierarchy.layer_nodes), and the sizes of cells and chunks."""

    cells: DataFrame
    nodes: DataFrame
    cell: tuple = (1.0, 1.0, 1.0)
    chunk_cells: tuple = (1, 1, 1)

    def level2(self, points: DataFrame, voxel=VOXEL_NM) -> DataFrame:
        """points(x, y, z in nm, ..) with l2_id, null where there is none."""
        found = points_to_segments(points, self.cells, self.cell, voxel=voxel, integer=True, stop_layer=2, nodes=self.nodes, chunk_cells=self.chunk_cells)
        return found.select(*(c for c in points.columns if c != "l2_id"), F.nullif(F.col("segment_id"), F.lit(0)).alias("l2_id"))


def lookup_service(points: DataFrame, fetch, chunksize: int = 2000) -> DataFrame:
    """points(x, y, z, ..) with segment_id from a remote service: fetch(list of (x, y, z)) gives ids as text.

    Each partition sends chunks of at most chunksize points. A chunk that fails is sent again in halves until it cannot
    shrink; points that still fail keep "0". A partition of a single chunk lets its error through.
    """
    schema = StructType([*points.schema.fields, StructField("segment_id", StringType())])

    def halves(rows: list) -> list[str]:
        try:
            return list(fetch(rows))
        except Exception:
            if len(rows) == 1:
                return ["0"]
            middle = max(round(len(rows) / 2), 1)
            return halves(rows[:middle]) + halves(rows[middle:])

    def look(frames):
        frames = iter(frames)
        pdf, after = next(frames, None), next(frames, None)
        alone = after is None and pdf is not None and len(pdf) <= chunksize
        while pdf is not None:
            rows = list(map(tuple, pdf[["x", "y", "z"]].to_numpy(float)))
            chunks = [rows[i : i + chunksize] for i in range(0, len(rows), chunksize)]
            yield pdf.assign(segment_id=[i for c in chunks for i in (fetch(c) if alone else halves(c))])
            pdf, after = after, next(frames, None)

    return points.mapInPandas(look, schema)


def failed_lookups(df: DataFrame, column: str = "segment_id") -> Column:
    """Points that got no segment (those that lie in none too)."""
    return F.count_if(F.col(column).cast("string") == "0")
