"""Connected components of an edge table by alternating large-star and small-star steps.

The small step is done by tasks: each turns the edges that it holds, a bounded number at a time, into stars, so that it
passes on one edge for each node at most; then a node's edges, no more than there were such runs, meet in one task and
become stars again. The large step hands each edge's lower end on to that node's own least neighbour.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import removed, with_groups, written

MOST_ROUNDS = 60
#: Edges that a task turns into stars at once.
STAR_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) for all nodes that the edges a, b connect with a smaller one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    some = root < np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def _stars(by_node: bool):
    """Turns a partition's edges into stars; by_node: they are in order of a, and those of one a stay together."""

    def run(batches):
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += len(batch)
            if batch is not None and rows < STAR_EDGES or not rows:
                continue
            a, b = (np.concatenate([kept, *(r.column(c).to_numpy() for r in held)]) for c, kept in enumerate((a, b)))
            stop = int(np.searchsorted(a, a[-1])) if by_node and batch is not None else len(a)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a[:stop], b[:stop])], ["a", "b"])
            a, b = a[stop:], b[stop:]
            held, rows = [], len(a)

    return run


def _small_star(edges: DataFrame) -> DataFrame:
    local = edges.mapInArrow(_stars(False), "a long, b long")
    return written(local.repartition("a").sortWithinPartitions("a").mapInArrow(_stars(True), "a long, b long"), "edges")


def _nodes(edges: DataFrame) -> DataFrame:
    """Nodes with greater neighbours, or with several smaller ones: the least and greatest smaller neighbour (null: none), and how many greater ones there are."""
    ends = edges.select(F.col("a").alias("of"), F.col("b").alias("low"), F.lit(0).alias("up")).union(edges.select("b", F.lit(None).cast("long"), F.lit(1)))
    return ends.groupBy("of").agg(F.min("low").alias("low"), F.max("low").alias("high"), F.sum("up").alias("n")).where("n > 0 or low <> high")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge to another one; component is the least node of it.

    edges: two columns a, b of type long, in any order and number; those with a null end or both ends the same are left
    out. The edge table is written to the shared folder in each round, where the last round's is deleted; only its size
    and whether it has settled reach the driver. with_groups deals the edges of a hub over all partitions.
    """
    edges = _small_star(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")))
    for _ in range(MOST_ROUNDS):
        nodes = _nodes(edges)
        total, loose = nodes.agg(F.sum("n"), F.count_if(F.expr("low <> high or n > 0 and low is not null"))).first()
        if not loose:
            edges = edges.distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        # Large step: a settled lower end has no smaller neighbour and stays.
        lower = nodes.where("n > 0").select("of", "low", "n")
        last, edges = edges, _small_star(with_groups(edges, lower, {"b": "of"}, "n", total, "a").select("a", F.coalesce("low", "b").alias("b")))
        removed(last)
    raise RuntimeError("components did not settle")


def named(rows: DataFrame, node_col: str, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with component_id: the least id of the component that their node is in.

    nodes: one row for each node, with the columns node_col, least (its rows' least id) and copies (how many rows it has);
    roots: as components gives them, nodes without a link left out. Neither a node of many copies nor a component of many
    nodes meets in one task.
    """
    placed = nodes.join(roots, nodes[node_col] == roots["node"], "left").select(F.col(node_col).alias("of"), "least", "copies", F.coalesce("component", node_col).alias("root"))
    placed = written(placed, "placed")
    names = placed.groupBy(F.col("root").alias("name")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    found = with_groups(placed, names, {"root": "name"}, "n", placed.count(), "of").select("of", "copies", "component_id")
    return with_groups(rows, found, {node_col: "of"}, "copies", rows.count(), "doc_id").select(*rows.columns, "component_id")
