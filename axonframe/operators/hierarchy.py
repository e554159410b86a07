"""The chunk hierarchy above supervoxels: which node holds a supervoxel at each layer, at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.chunks import ROOT_LAYER, chunk_at, layer_of
from axonframe.functions.columns import require_columns
from axonframe.functions.shared import fresh, stored

#: Layers that are walked at most; a higher parent than that is an error in the table.
MOST_LAYERS = 14


def valid_at(df: DataFrame, at: Column | None) -> DataFrame:
    """Rows whose interval [valid_from, valid_to) holds the moment; all rows where it is None. Null ends are open."""
    if at is None:
        return df
    return df.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def layer_nodes(supervoxels: DataFrame, parents: DataFrame, layers: int, at: Column | None = None) -> DataFrame:
    """(layer, chunk, supervoxel_id, node_id): the node that holds each supervoxel at layers 1 to `layers`, and its root as layer ROOT_LAYER.

    supervoxels(supervoxel_id, chunk), chunk the Morton code of layer 2; parents(child_id, parent_id[, valid_from,
    valid_to]), at most one valid row for each child. Ids carry their layer. Where a parent skips layers, its child stands
    for the skipped ones. A supervoxel without parent is its own root; null ids are left out; of several parents at one
    moment the least counts. chunk is that of the row's layer (for the root zero, the code of all space), so that a lookup
    is one join on layer, chunk and supervoxel, and a table partitioned by layer and chunk is read in part.
    """
    require_columns(supervoxels, "supervoxel_id", "chunk")
    require_columns(parents, "child_id", "parent_id", *(("valid_from", "valid_to") if at is not None else ()))
    if not 1 <= layers <= MOST_LAYERS:
        raise ValueError(f"layers must be 1 to {MOST_LAYERS}")
    up = valid_at(parents, at).where("child_id IS NOT NULL AND parent_id IS NOT NULL").groupBy(F.col("child_id").alias("below")).agg(F.min("parent_id").alias("above"))
    up = stored(up, "parents")  # used at each layer; as a table of its own its joins can be split where a node is hot
    rows = supervoxels.where("supervoxel_id IS NOT NULL").groupBy("supervoxel_id").agg(F.min("chunk").alias("chunk")).withColumn("n1", F.col("supervoxel_id"))
    for k in range(2, layers + 1):
        # The node of layer k is the parent of that of layer k - 1 where it lies at k, else still the latter.
        rows = rows.join(up, F.col(f"n{k - 1}") == F.col("below"), "left")
        rows = rows.withColumn(f"n{k}", F.when(layer_of(F.col("above")) <= k, F.col("above")).otherwise(F.col(f"n{k - 1}"))).drop("below", "above")
    roots = _roots(up)
    rows = rows.join(roots, F.col(f"n{layers}") == F.col("of"), "left").withColumn("root", F.coalesce("top", f"n{layers}"))
    entry = lambda layer, chunk, node: F.struct(F.lit(layer).alias("layer"), chunk.cast("long").alias("chunk"), node.alias("node_id"))
    entries = F.array(*(entry(k, chunk_at(F.col("chunk"), k), F.col(f"n{k}")) for k in range(1, layers + 1)), entry(ROOT_LAYER, F.lit(0), F.col("root")))
    return rows.select("supervoxel_id", F.explode(entries).alias("e")).select("e.layer", "e.chunk", "supervoxel_id", "e.node_id")


def _roots(up: DataFrame) -> DataFrame:
    """(of, top): the topmost ancestor of each node that has a parent, by joins that double the height that they cover."""
    jumps = up.select(F.col("below").alias("of"), F.col("above").alias("top"))
    height = 1
    while height < MOST_LAYERS:
        further = jumps.select(F.col("of").alias("from"), F.col("top").alias("to"))
        jumps = jumps.join(further, F.col("top") == F.col("from"), "left").select("of", F.coalesce("to", "top").alias("top"))
        height *= 2
    return jumps


def nodes_of_points(points: DataFrame, nodes: DataFrame, stop_layer: int | None, chunk: str, supervoxel: str, out: str) -> DataFrame:
    """points with out: the node of layer_nodes that holds their supervoxel at a layer (None: the root); null where there is none. chunk: the Morton code of the point's chunk of layer 2."""
    layer = ROOT_LAYER if stop_layer is None else stop_layer
    of, place, node = (fresh(n, points) for n in ("of", "place", "node"))
    wanted = nodes.where(F.col("layer") == layer).select(F.col("supervoxel_id").alias(of), F.col("chunk").alias(place), F.col("node_id").alias(node))
    here = F.lit(0).cast("long") if stop_layer is None else chunk_at(F.col(chunk), layer)
    joined = points.join(wanted, (F.col(supervoxel) == F.col(of)) & (here == F.col(place)), "left")
    return joined.withColumn(out, F.col(node)).drop(of, place, node)
