"""Mesh fragments put together: offsets of their vertices, and border vertices of several fragments welded to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import require_columns
from axonframe.functions.shared import dropped, stored
from axonframe.operators.maintenance import numbered
from axonframe.operators.ranks import running_before

#: Rounds of hooking; each at least halves the trees that can still be joined.
MOST_ROUNDS = 60


def concat_meshes(fragments: DataFrame) -> DataFrame:
    """Faces of fragments(fragment, n_vertices, faces: array<array<int>>) with indices into the joined vertex list: each fragment's shift is the number of vertices before it. Fragments are ordered by range partitions; no task sees them all."""
    shifted = running_before(fragments.select("fragment", F.col("n_vertices").cast("long").alias("n_vertices"), "faces"), "fragment", "n_vertices", "shift")
    return shifted.select("fragment", F.posexplode("faces").alias("face", "v"), "shift").select("fragment", "face", F.transform("v", lambda i: i + F.col("shift")).alias("v"))


def linked(edges: DataFrame) -> DataFrame:
    """(node, least): the least node of each node's connected component, for nodes of edges(a, b) of type long.

    A round hooks every tree to the least tree beside it, then lets pointers skip to their roots; edges within one tree
    fall away. Trees and edges are tables of the shared folder, and only whether edges are left reaches the driver.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    trees = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("least", F.col("node"))
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            return trees
        hooks = stored(edges.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")), "hooks")
        while True:
            further = hooks.select(F.col("root").alias("mid"), F.col("to").alias("next"))
            moved = stored(hooks.join(further, F.col("to") == F.col("mid"), "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            settled = moved.where("moved").isEmpty()
            dropped(hooks)
            hooks = moved.select("root", "to")
            if settled:
                break
        hooked = hooks.select("root", F.col("to").alias("onto"))
        trees = stored(trees.join(hooked, F.col("least") == F.col("root"), "left").select("node", F.coalesce("onto", "least").alias("least")), "trees")
        ends = [hooks.select(F.col("root").alias(f"r{c}"), F.col("to").alias(f"t{c}")) for c in "ab"]
        up = edges.join(ends[0], F.col("a") == F.col("ra"), "left").join(ends[1], F.col("b") == F.col("rb"), "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        edges = stored(up.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    raise RuntimeError("trees did not settle")


def weld(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(vertices(index, x, y, z), faces(fragment, face, v)) of one mesh, from vertices(fragment, vertex, x, y, z) and faces(fragment, face, v: array<int>) of its fragments.

    Vertices nearer to each other than the tolerance, and what such vertices connect, become one: the first by place, which
    gives its coordinates. Vertices of one place are one row before they are compared; then each place is compared with
    those in the cells of space that its tolerance reaches (one cell inside, up to eight at a corner). Indices count from
    zero in order of place. Faces that lose a corner to welding are left out; a vertex that no face names stays. Faces
    with an index that their fragment lacks are an error of the fragment and are left out too; so are vertices with
    nulls, and faces of them.
    """
    require_columns(vertices, "fragment", "vertex", "x", "y", "z")
    require_columns(faces, "fragment", "face", "v")
    if not tolerance > 0:
        raise ValueError("tolerance must be above zero")
    rows = vertices.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND fragment IS NOT NULL AND vertex IS NOT NULL").select("fragment", "vertex", *((F.col(a).cast("double") + 0.0).alias(a) for a in "xyz"))
    places = stored(numbered(rows.select("x", "y", "z").distinct().withColumn("place", F.struct("x", "y", "z")), "place", "number").select("x", "y", "z", "number"), "places")
    size = 4 * tolerance
    low, high = (F.array(*(F.floor((F.col(a) + d) / size) for a in "xyz")) for d in (-tolerance, tolerance))
    near = places.withColumns({"low": low, "high": high})
    for i, a in enumerate("xyz"):
        near = near.withColumn(f"c{a}", F.explode(F.array_distinct(F.array(F.col("low")[i], F.col("high")[i]))))
    near = near.drop("low", "high")
    other = near.select(*(F.col(c).alias(f"o{c}") for c in near.columns))
    gap = sum(((F.col(a) - F.col(f"o{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    pairs = near.join(other, (F.col("cx") == F.col("ocx")) & (F.col("cy") == F.col("ocy")) & (F.col("cz") == F.col("ocz")) & (F.col("number") < F.col("onumber")) & (gap <= tolerance * tolerance))
    groups = linked(pairs.select(F.col("onumber").alias("a"), F.col("number").alias("b"))).select(F.col("node").alias("of"), "least")
    joined = places.join(groups, F.col("number") == F.col("of"), "left").select("x", "y", "z", "number", F.coalesce("least", "number").alias("least"))
    heads = stored(numbered(joined.where("least = number"), "number", "rank").select("x", "y", "z", F.col("number").alias("head"), (F.col("rank") - 1).alias("index")), "heads")
    indexed = joined.select("x", "y", "z", "least").join(heads.select("head", "index"), F.col("least") == F.col("head"))
    indexed = indexed.select(*(F.col(a).alias(f"p{a}") for a in "xyz"), "index")
    names = rows.join(indexed, (F.col("x") == F.col("px")) & (F.col("y") == F.col("py")) & (F.col("z") == F.col("pz"))).select(F.col("fragment").alias("of_fragment"), "vertex", "index")
    corners = faces.select("fragment", "face", F.size("v").alias("size"), F.posexplode("v").alias("corner", "local"))
    found = corners.join(names, (F.col("fragment") == F.col("of_fragment")) & (F.col("local") == F.col("vertex"))).groupBy("fragment", "face").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("corner", "index"))).alias("c"))
    whole = found.select("fragment", "face", "size", F.transform("c", lambda s: s["index"]).alias("v")).where((F.size("v") == F.col("size")) & (F.size(F.array_distinct("v")) == F.col("size")))
    return heads.select("index", "x", "y", "z"), whole.select("fragment", "face", "v")
