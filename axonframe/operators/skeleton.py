"""Skeletons: rooted trees of nodes (root_id, node_id, parent_id, x, y, z, w), parent -1 at the root."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import is_finite, require_columns
from axonframe.functions.coords import VOXEL_NM, convert_units
from axonframe.functions.shared import stored
from axonframe.operators.geometry import Mesh, mesh_distance, nearest_rows
from axonframe.operators.paths import DECIMALS, branch_points

NODE = ("root_id", "node_id", "parent_id", "x", "y", "z")


def degrees(nodes: DataFrame) -> DataFrame:
    """nodes with degree (edges at the node) and kind: end (one edge or none, the root too), branch (three or more) or slab; is_root marks parent -1. One partial aggregate over the edge list."""
    require_columns(nodes, *NODE)
    edges = nodes.where("parent_id <> -1").select("root_id", F.explode(F.array("node_id", "parent_id")).alias("node"))
    counts = edges.groupBy(F.col("root_id").alias("__r"), F.col("node").alias("__n")).agg(F.count(F.lit(1)).cast("int").alias("degree"))
    joined = nodes.join(counts, (F.col("root_id") == F.col("__r")) & (F.col("node_id") == F.col("__n")), "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kind = F.when(F.col("degree") <= 1, "end").when(F.col("degree") >= 3, "branch").otherwise("slab")
    return joined.select(*nodes.columns, "degree", kind.alias("kind"), (F.col("parent_id") == -1).alias("is_root"))


def cable_lengths(nodes: DataFrame) -> DataFrame:
    """Per root: number of nodes and summed length of its edges."""
    parent = nodes.select(F.col("root_id").alias("r"), F.col("node_id").alias("n"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    edge = sum(((F.col(a) - F.col(f"p{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    joined = nodes.join(parent, (F.col("root_id") == F.col("r")) & (F.col("parent_id") == F.col("n")), "left")
    return joined.groupBy("root_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.sqrt(edge)).alias("length"))


def root_points(nodes: DataFrame, points: DataFrame | None = None, method: str = "auto", mesh: Mesh | None = None, offset: float = 0.0) -> DataFrame:
    """The node of each skeleton that should be its root: nearest to the skeleton's point (root_id, px, py, pz), else the end that lies farthest outside the mesh.

    A finite point goes before the mesh in auto; skeletons with neither give no row there, and an error for an explicit
    method without its source.
    """
    if method not in ("auto", "point", "mesh"):
        raise ValueError(f"unknown method {method!r}")
    if method == "point" and points is None or method == "mesh" and mesh is None:
        raise ValueError(f"method {method} has no source")
    found = None
    if method != "mesh" and points is not None:
        finite = is_finite(F.col("px")) & is_finite(F.col("py")) & is_finite(F.col("pz"))
        found = nearest_rows(points.where(finite), nodes).select("root_id", "node_id", "x", "y", "z")
    if method != "point" and mesh is not None:
        ends = mesh_distance(degrees(nodes).where("kind = 'end'"), mesh, out="__d").withColumn("__d", F.col("__d") + offset)
        best = ends.groupBy("root_id").agg(F.min_by(F.struct("node_id", "x", "y", "z"), F.struct("__d", "node_id")).alias("b")).select("root_id", "b.*")
        if found is not None:
            best = best.join(found.select(F.col("root_id").alias("__f")), F.col("root_id") == F.col("__f"), "left_anti")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return nodes.select("root_id", "node_id", "x", "y", "z").limit(0)
    return found


def _whole_trees(nodes: DataFrame, f, schema) -> DataFrame:
    """f over frames that hold many trees, each whole and its rows together: trees are dealt by root and sorted, and a frame's last tree waits for the next frame. Rows without root are left out."""

    def run(frames):
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            keys = pdf["root_id"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held = pdf.iloc[cut:]
            if cut:
                yield f(pdf.iloc[:cut].reset_index(drop=True))
        if held is not None and len(held):
            yield f(held.reset_index(drop=True))

    return nodes.where("root_id IS NOT NULL").repartition("root_id").sortWithinPartitions("root_id", "node_id").mapInPandas(run, schema)


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each tree's rows begin and end."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def _parents_from(parent: dict, root) -> dict:
    """The parents of the same tree hung from another root: pointers along the path are turned around."""
    turned, child, at = dict(parent), -1, root
    while at in parent:
        above = parent[at]
        turned[at] = child
        child, at = at, above
    return turned


def reroot(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with parents as seen from roots(root_id, node_id); skeletons without a row stay as they are. A tree is turned in one task: that needs the whole path."""
    joined = nodes.join(roots.select(F.col("root_id").alias("__r"), F.col("node_id").alias("__new")), F.col("root_id") == F.col("__r"), "left").drop("__r")

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        node, parent, new = pdf["node_id"].to_numpy(), pdf["parent_id"].to_numpy().copy(), pdf["__new"].to_numpy(float)
        for a, b in _bounds(pdf["root_id"].to_numpy()):
            place = {} if np.isnan(new[a]) else dict(zip(node[a:b].tolist(), range(a, b)))
            child, at = -1, -1 if np.isnan(new[a]) else int(new[a])
            while (i := place.pop(at, None)) is not None:
                above, parent[i] = int(parent[i]), child
                child, at = at, above
        return pdf.assign(parent_id=parent).drop(columns="__new")

    return _whole_trees(joined, turn, nodes.schema)


def _lengths(nodes: dict, parent: dict, root) -> dict:
    """Path length of each node from root along the tree."""
    near: dict = {n: [] for n in nodes}
    for n, p in parent.items():
        if p in nodes:
            near[n].append(p)
            near[p].append(n)
    seen, todo = {root: 0.0}, [root]
    while todo:
        at = todo.pop()
        for n in near[at]:
            if n not in seen:
                seen[n] = seen[at] + math.dist(nodes[n], nodes[at])
                todo.append(n)
    return seen


def key_node(nodes: dict, parent: dict) -> tuple[int, bool]:
    """The main branch point, and whether it is one: from the end farthest from the first root, the place where the longest side path leaves the longest path. Without a branch: that end."""
    degree: dict = {n: 0 for n in nodes}
    for n, p in parent.items():
        if p in nodes:
            degree[n] += 1
            degree[p] += 1
    first = min(n for n, p in parent.items() if p not in nodes)
    far = _lengths(nodes, parent, first)
    ends = [n for n in far if degree[n] <= 1]
    start = max(ends, key=lambda n: (round(far[n], DECIMALS), -n))
    turned = _parents_from(parent, start)
    length = _lengths(nodes, turned, start)
    leaves = sorted((n for n in length if degree[n] <= 1 and n != start), key=lambda n: (-round(length[n], DECIMALS), n))
    if not leaves:
        return start, False
    spine, at = set(), leaves[0]
    while at in nodes:
        spine.add(at)
        at = turned[at]
    best, place = 0.0, None
    for leaf in leaves[1:]:
        at = leaf
        while at not in spine:
            at = turned[at]
        if round(length[leaf] - length[at], DECIMALS) > best:
            best, place = round(length[leaf] - length[at], DECIMALS), at
    return (start, False) if place is None else (place, True)


#: Trees of more nodes are walked by joins over many tasks, all others whole, many to a task.
LARGE = 1_000_000


def key_points(nodes: DataFrame, ids: DataFrame | None = None, raw: bool = True, voxel=VOXEL_NM, large: int = LARGE) -> DataFrame:
    """root_id, x, y, z, branched, failed: the main branch point of each skeleton, in voxels where raw. A skeleton that cannot be walked gives nulls and failed; ids(root_id) without a skeleton too."""
    require_columns(nodes, *NODE)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        roots, node, parent, xyz = pdf["root_id"].to_numpy(), pdf["node_id"].tolist(), pdf["parent_id"].tolist(), pdf[["x", "y", "z"]].to_numpy(float)
        rows = []
        for a, b in _bounds(roots):
            try:
                places = dict(zip(node[a:b], xyz[a:b]))
                at, branched = key_node(places, dict(zip(node[a:b], parent[a:b])))
                rows.append([roots[a], *places[at], branched, False])
            except (ValueError, KeyError):
                rows.append([roots[a], None, None, None, None, True])
        return pd.DataFrame(rows, columns=["root_id", "x", "y", "z", "branched", "failed"])

    nodes = nodes.select(*NODE)
    sizes = nodes.groupBy(F.col("root_id").alias("of_root")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > large)
    big = stored(sizes.select("of_root"), "large")
    of_big = F.col("root_id").eqNullSafe(F.col("of_root"))
    out = _whole_trees(nodes.join(big, of_big, "left_anti"), find, "root_id long, x double, y double, z double, branched boolean, failed boolean")
    if not big.isEmpty():
        some = stored(nodes.join(big, of_big, "left_semi"), "trees")
        found = branch_points(some).select(F.col("root_id").alias("r"), F.col("node_id").alias("e"), "branched")
        places = some.join(found, F.col("root_id").eqNullSafe(F.col("r")) & (F.col("node_id") == F.col("e"))).groupBy("root_id").agg(F.min(F.struct("x", "y", "z", "branched")).alias("p")).select("root_id", "p.*")
        places = big.select(F.col("of_root").alias("root_id")).where("root_id IS NOT NULL").join(places.withColumnRenamed("root_id", "r"), F.col("root_id").eqNullSafe(F.col("r")), "left")
        out = out.unionByName(places.select("root_id", "x", "y", "z", "branched", F.col("branched").isNull().alias("failed")))
    if raw:
        out = convert_units(out, "raw", voxel)
    if ids is not None:
        found = out.withColumnRenamed("root_id", "__r")
        out = ids.select("root_id").join(found, F.col("root_id") == F.col("__r"), "left").select("root_id", "x", "y", "z", "branched", F.coalesce("failed", F.lit(True)).alias("failed"))
    return out


def read_neurons(nodes: DataFrame, ids: DataFrame, somata: DataFrame | None = None, previous: DataFrame | None = None, units: str = "nm", voxel=VOXEL_NM) -> tuple[DataFrame, DataFrame]:
    """(nodes, neurons) for ids(ordinal, root_id): skeletons hung from the node nearest to the soma, in the given units, and one row per neuron in input order with the soma's provenance.

    Skeletons in `previous` are reused, others are read; somata has rows of soma.RESULT.
    """
    wanted = ids.select(F.col("root_id").alias("__w")).distinct()
    mine = nodes.join(wanted, F.col("root_id") == F.col("__w"), "left_semi")
    if previous is not None:
        have = previous.join(wanted, F.col("root_id") == F.col("__w"), "left_semi")
        known = previous.select(F.col("root_id").alias("__h")).distinct()
        mine = have.unionByName(mine.join(known, F.col("root_id") == F.col("__h"), "left_anti"))
    neurons = ids.groupBy("root_id").agg(F.min("ordinal").alias("ordinal"))
    if somata is not None:
        parts = F.split("position", ",")
        points = somata.where("position IS NOT NULL").select("root_id", *[F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(f"p{a}") for i, a in enumerate("xyz")])
        mine = reroot(mine, root_points(mine, points.dropDuplicates(["root_id"]), "point"))
        provenance = somata.select(F.col("root_id").alias("__s"), F.col("source").alias("soma_source"), "n_nuclei", "nucleus_id", "soma_score", "dist_npil_nm", "l2_id")
        neurons = neurons.join(provenance.dropDuplicates(["__s"]), F.col("root_id") == F.col("__s"), "left").drop("__s")
    return convert_units(mine, units, voxel), neurons


def unplaced(neurons: DataFrame) -> DataFrame:
    """One row: missing (neurons of read_neurons whose soma was not found, so that they could not be rerooted) and total."""
    return neurons.agg(F.count_if(F.col("soma_source").isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))


def warn_unplaced(neurons: DataFrame) -> int:
    """Warns how many neurons could not be rerooted, if any; their number."""
    missing, total = unplaced(neurons).first()
    if missing:
        warnings.warn(f"{missing} of {total} neurons could not be rerooted; their soma_source is null", stacklevel=2)
    return missing
