"""Paths in trees that need not fit one task: distances to marked ancestors, ancestors of nodes, and main branch points.

A tree's nodes are dealt by range of (root_id, node_id). Each task follows the pointers that it holds to their ends, so
that a node points out of its piece at once: skeleton ids mostly run along branches, and few nodes are left that others
point to from outside. Those alone are resolved by rounds of joins that double the height covered; one more join gives
every node its answer. With ids in random order nothing contracts, and the rounds work on all nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import require_columns
from axonframe.functions.shared import dropped, stored

#: Nodes of a piece that one task contracts at once: what a task of Python holds, whatever the partitions are.
PIECE = 1 << 16
#: Decimals of nm to which path lengths are compared, so that their order does not hang on the order of sums.
DECIMALS = 6


def edges(nodes: DataFrame) -> DataFrame:
    """(root_id, node_id, up, length): each node's parent (null at a root, or where the parent is not in the tree) and the distance to it. Of rows with the same ids the first by parent and place counts; null ids are left out."""
    require_columns(nodes, "root_id", "node_id", "parent_id", "x", "y", "z")
    rows = nodes.where("root_id IS NOT NULL AND node_id IS NOT NULL").groupBy("root_id", "node_id").agg(F.min(F.struct("parent_id", "x", "y", "z")).alias("n")).select("root_id", "node_id", "n.*")
    ends = nodes.where("root_id IS NOT NULL AND node_id IS NOT NULL").groupBy(F.col("root_id").alias("r"), F.col("node_id").alias("p")).agg(F.min(F.struct("parent_id", "x", "y", "z")).alias("n"))
    ends = ends.select("r", "p", *(F.col("n")[a].alias(f"p{a}") for a in "xyz"))
    # Null-safe, so that the parents are dealt anew and a node with very many children can be split.
    joined = rows.join(ends, F.col("root_id").eqNullSafe(F.col("r")) & F.col("parent_id").eqNullSafe(F.col("p")), "left")
    gap = sum(((F.col(a) - F.col(f"p{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    return joined.select("root_id", "node_id", F.col("p").alias("up"), F.when(F.col("p").isNotNull(), F.coalesce(F.sqrt(gap), F.lit(0.0))).otherwise(0.0).alias("length"))


def _places(root: np.ndarray, node: np.ndarray, up: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Each node's parent's place in the piece, or -1. Rows are in order of (root, node)."""
    tree = np.unique(root, return_inverse=True)[1]
    rank = np.unique(np.concatenate([node, up]), return_inverse=True)[1]
    key = tree.astype(np.int64) * len(rank) + rank[: len(node)]
    ask = tree.astype(np.int64) * len(rank) + rank[len(node) :]
    at = np.minimum(np.searchsorted(key, ask), len(key) - 1)
    return np.where(has & (key[at] == ask), at, -1)


def _pieces(batches, rows: int):
    """Batches put together to tables of about `rows` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _contract(batches):
    import uuid

    for table in _pieces(batches, PIECE):
        get = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        root, node, length, stop = (get(c) for c in ("root_id", "node_id", "length", "stop"))
        has = table["up"].is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        up = table["up"].fill_null(0).combine_chunks().to_numpy()
        step = _places(root, node, up, has)
        own = np.arange(len(node))
        final = stop | ~has
        to = np.where(final | (step < 0), own, step)
        far, first = np.where(to == own, 0.0, length), to.copy()
        for _ in range(len(node).bit_length() + 1):
            if np.array_equal(to, to[to]):
                break
            far, to = far + far[to], to[to]
        ended = first[to] == to
        leaves = ended & ~final[to]
        top = np.where(ended, np.where(leaves, up[to], node[to]), up)
        far = np.where(ended, far + np.where(leaves, length[to], 0.0), length)
        piece = np.full(len(node), uuid.uuid4().int >> 65)
        yield pa.RecordBatch.from_arrays([table["root_id"].combine_chunks(), table["node_id"].combine_chunks(), pa.array(top.astype(np.int64)), pa.array(far), pa.array(leaves | ~ended), table["up"].combine_chunks(), pa.array(piece)], ["root_id", "node_id", "top", "far", "open", "up", "piece"])


def _ranged(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("root_id", "node_id").sortWithinPartitions("root_id", "node_id")


def contracted(tree: DataFrame, stop: Column) -> DataFrame:
    """tree(root_id, node_id, up, length) with top and far: as far up as its piece and the stops allow; open where that is no stop."""
    rows = tree.select("root_id", "node_id", F.col("up").cast("long").alias("up"), "length", F.coalesce(stop, F.lit(False)).alias("stop"))
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("root_id", "node_id")})
    return stored(_ranged(rows).mapInArrow(_contract, "root_id long, node_id long, top long, far double, open boolean, up long, piece long"), "contracted")


def _asked(rows: DataFrame) -> DataFrame:
    """The rows that open ones point to."""
    asked = rows.where("open").select(F.col("root_id").alias("r"), F.col("top").alias("t")).distinct()
    return rows.join(asked, F.col("root_id").eqNullSafe(F.col("r")) & F.col("node_id").eqNullSafe(F.col("t")), "left_semi")


def _jumped(rows: DataFrame, by: DataFrame) -> DataFrame:
    """Open rows carried on by the rows that they point to."""
    further = by.select(F.col("root_id").alias("r"), F.col("node_id").alias("t"), F.col("top").alias("next"), F.col("far").alias("more"), F.col("open").alias("still"))
    going = rows.where("open").join(further, (F.col("root_id") == F.col("r")) & (F.col("top") == F.col("t")), "left")
    kept = [c for c in rows.columns if c not in ("top", "far", "open")]
    moved = going.select("root_id", "node_id", F.coalesce("next", "top").alias("top"), (F.col("far") + F.coalesce("more", F.lit(0.0))).alias("far"), F.coalesce("still", F.lit(True)).alias("open"), *(c for c in kept if c not in ("root_id", "node_id")))
    return rows.where("NOT open").select(*moved.columns).union(moved)


def climb(tree: DataFrame, stop: Column | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """(root_id, node_id, top, far): the first node at or above each node that is a stop or a root, and the path length to it.

    Nodes on a cycle, or below one, get nulls. pieces: contracted(tree, stop), if it is there already.
    """
    rows = contracted(tree, F.lit(False) if stop is None else stop) if pieces is None else pieces
    gates = stored(_asked(rows).select("root_id", "node_id", "top", "far", "open"), "gates")
    n = gates.count()
    for _ in range(n.bit_length() + 1):
        if gates.where("open").isEmpty():
            break
        last, gates = gates, stored(_jumped(gates, gates), "gates")
        dropped(last)
    out = _jumped(rows.select("root_id", "node_id", "top", "far", "open"), gates)
    return out.select("root_id", "node_id", F.when(~F.col("open"), F.col("top")).alias("top"), F.when(~F.col("open"), F.col("far")).alias("far"))


def distances(nodes: DataFrame) -> DataFrame:
    """(root_id, node_id, top, distance): each node's path length along the tree to its root, and which root that is; nulls on cycles. The rows of nodes count once for each id."""
    return climb(stored(edges(nodes), "edges")).withColumnRenamed("far", "distance")


def _marked(batches_schema):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root_id", "ascending"), ("node_id", "ascending")])
        get = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        has = table["up"].is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        step = _places(get("root_id"), get("node_id"), table["up"].fill_null(0).combine_chunks().to_numpy(), has)
        to, marks = np.where(step < 0, np.arange(len(step)), step), get("entry").astype(bool)
        for _ in range(len(step).bit_length() + 1):
            marks[to[marks]] = True
            to = to[to]
        return table.filter(pa.array(marks)).select(["root_id", "node_id"]).cast(batches_schema)

    return run


def ancestors(pieces: DataFrame, ends: DataFrame) -> DataFrame:
    """(root_id, node_id) of the nodes ends(root_id, node_id) and all nodes above them; pieces: contracted(tree, no stops).

    Which gates the paths pass is found among the gates alone, with as many rounds as their number has bits; then each
    piece that a path enters is walked in one task, of PIECE nodes or a little more.
    """
    gates = stored(_asked(pieces).select("root_id", "node_id", "top", "far", "open"), "gates")
    first = pieces.join(ends.select(F.col("root_id").alias("r"), F.col("node_id").alias("e")), (F.col("root_id") == F.col("r")) & (F.col("node_id") == F.col("e")), "left_semi")
    entered = stored(first.select("root_id", "node_id").union(first.where("open").select("root_id", "top")).distinct(), "entered")
    jumps = gates
    for _ in range(gates.count().bit_length() + 1):
        if jumps.where("open").isEmpty():
            break
        step = jumps.where("open").select(F.col("root_id").alias("r"), F.col("node_id").alias("e"), F.col("top").alias("next"))
        above = entered.join(step, (F.col("root_id") == F.col("r")) & (F.col("node_id") == F.col("e"))).select("root_id", F.col("next").alias("node_id"))
        last, entered = entered, stored(entered.union(above).distinct(), "entered")
        dropped(last)
        further = jumps.select(F.col("root_id").alias("r"), F.col("node_id").alias("t"), F.col("top").alias("next"), F.col("open").alias("still"))
        going = jumps.where("open").join(further, (F.col("root_id") == F.col("r")) & (F.col("top") == F.col("t")))
        # A jump whose end has no way out has nothing above it: only jumps that are still open go on.
        jumps = stored(going.select("root_id", "node_id", F.col("next").alias("top"), "far", F.col("still").alias("open")), "jumps")
    flags = entered.select(F.col("root_id").alias("r"), F.col("node_id").alias("e"))
    flagged = pieces.join(flags, F.col("root_id").eqNullSafe(F.col("r")) & F.col("node_id").eqNullSafe(F.col("e")), "left").select("root_id", "node_id", "up", "piece", F.col("e").isNotNull().alias("entry"))
    crossed = flagged.where("entry").select(F.col("piece").alias("crossed")).distinct()
    inside = flagged.join(crossed, F.col("piece") == F.col("crossed"), "left_semi")
    schema = pa.schema([("root_id", pa.int64()), ("node_id", pa.int64())])
    return inside.groupBy("piece").applyInArrow(_marked(schema), "root_id long, node_id long")


def _same(r: str = "r", e: str = "e") -> Column:
    return F.col("root_id").eqNullSafe(F.col(r)) & F.col("node_id").eqNullSafe(F.col(e))


def _flagged(tree: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """tree with a flag: the node is among nodes(root_id, node_id)."""
    some = nodes.select(F.col("root_id").alias("r"), F.col("node_id").alias("e"), F.lit(True).alias(name))
    return tree.join(some, _same(), "left").drop("r", "e").withColumn(name, F.coalesce(name, F.lit(False)))


def _best(rows: DataFrame, *order: Column) -> DataFrame:
    """Each root's greatest row by order: (of_root, best)."""
    return rows.groupBy(F.col("root_id").alias("of_root")).agg(F.max_by(F.struct(*rows.columns), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("best"))


def branch_points(nodes: DataFrame) -> DataFrame:
    """(root_id, node_id, branched), one row for each tree: the place where the longest side path leaves the longest path.

    The longest path starts at the end farthest from the first root (the least id without parent) and goes to the end
    farthest from there; nodes that the first root does not reach don't count. Ties go to the longer way from the start,
    then to the least id. Without a side path: the start, not branched. A tree without a root gives no row.

    All trees are worked on at once, by three climbs and two sets of ancestors; no tree meets in one task. With m the first
    node at or above v on the way from the root to the start, the way from the start to v is |start| - |m| + |m v|.
    """
    tree = stored(edges(nodes), "edges")
    degree = tree.where("up IS NOT NULL").select("root_id", F.explode(F.array("node_id", "up")).alias("e")).groupBy(F.col("root_id").alias("r"), "e").agg(F.count(F.lit(1)).alias("n"))
    plain = contracted(tree, F.lit(False))
    depth = climb(tree, pieces=plain).select(F.col("root_id").alias("r"), F.col("node_id").alias("e"), F.col("top").alias("origin"), F.col("far").alias("depth"))
    first = tree.where("up IS NULL").groupBy(F.col("root_id").alias("of_root")).agg(F.min("node_id").alias("first"))
    rows = tree.join(degree, _same(), "left").withColumn("end", F.coalesce("n", F.lit(0)) <= 1).drop("r", "e", "n")
    rows = rows.join(depth, _same()).drop("r", "e").join(first, F.col("root_id").eqNullSafe(F.col("of_root")) & (F.col("origin") == F.col("first"))).drop("of_root", "first", "origin")
    rows = stored(rows, "reached")
    of_tree = F.col("root_id").eqNullSafe(F.col("of_root"))
    less = -F.col("node_id")
    start = _best(rows.where("end").select("root_id", "node_id", "depth"), F.round("depth", DECIMALS), less)
    start = stored(start.select("of_root", F.col("best.node_id").alias("start"), F.col("best.depth").alias("start_depth")), "starts")

    way = stored(ancestors(plain, start.select(F.col("of_root").alias("root_id"), F.col("start").alias("node_id"))), "way")
    onto = climb(_flagged(tree, way, "on_way"), F.col("on_way")).select(F.col("root_id").alias("r"), F.col("node_id").alias("e"), F.col("top").alias("meets"), F.col("far").alias("aside"))
    heights = rows.select(F.col("root_id").alias("r2"), F.col("node_id").alias("e2"), F.col("depth").alias("meets_depth"))
    ends = rows.where("end").select("root_id", "node_id").join(onto, _same()).drop("r", "e")
    ends = ends.join(heights, F.col("root_id").eqNullSafe(F.col("r2")) & F.col("meets").eqNullSafe(F.col("e2"))).drop("r2", "e2").join(start, of_tree).drop("of_root")
    ends = ends.withColumn("length", F.col("start_depth") - F.col("meets_depth") + F.col("aside")).where("node_id <> start")
    ends = stored(ends.select("root_id", "node_id", "length", "meets", "meets_depth"), "ends")
    goal = _best(ends, F.round("length", DECIMALS), less).select("of_root", F.col("best.node_id").alias("goal"), F.col("best.meets").alias("bend"), F.col("best.meets_depth").alias("bend_depth"))
    goal = stored(goal, "goals")

    other = stored(ancestors(plain, goal.select(F.col("of_root").alias("root_id"), F.col("goal").alias("node_id"))), "way")
    marks = way.select("root_id", "node_id", F.lit(1).alias("ways")).union(other.select("root_id", "node_id", F.lit(1))).groupBy("root_id", "node_id").agg(F.sum("ways").alias("ways"))
    marks = stored(marks, "marks")
    above = climb(_flagged(tree, marks, "marked"), F.col("marked")).select(F.col("root_id").alias("r"), F.col("node_id").alias("e"), F.col("top").alias("meets_now"), F.col("far").alias("side"))
    sides = ends.select("root_id", "node_id", "length").join(above, _same()).drop("r", "e").join(goal, of_tree).drop("of_root").where("node_id <> goal")
    twice = marks.join(rows.select(F.col("root_id").alias("r"), F.col("node_id").alias("e"), "depth"), _same()).select(F.col("root_id").alias("r2"), F.col("node_id").alias("e2"), "ways", F.col("depth").alias("at_depth"))
    sides = sides.join(twice, F.col("root_id").eqNullSafe(F.col("r2")) & F.col("meets_now").eqNullSafe(F.col("e2")))
    # A mark of both ways other than their bend lies above it: from there the side path comes down to the bend.
    over = (F.col("ways") == 2) & (F.col("meets_now") != F.col("bend"))
    sides = sides.select("root_id", "node_id", "length", F.when(over, F.col("bend")).otherwise(F.col("meets_now")).alias("place"), (F.col("side") + F.when(over, F.col("bend_depth") - F.col("at_depth")).otherwise(0.0)).alias("side"))
    side = _best(sides.where(F.round("side", DECIMALS) > 0), F.round("side", DECIMALS), F.round("length", DECIMALS), less).select(F.col("of_root").alias("r"), F.col("best.place").alias("place"))
    found = start.join(side, F.col("of_root").eqNullSafe(F.col("r")), "left")
    return found.select(F.col("of_root").alias("root_id"), F.coalesce("place", "start").alias("node_id"), F.col("place").isNotNull().alias("branched"))
