"""Queries over the proxy tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions import chunks, coords
from axonframe.functions.columns import number_text
from axonframe.functions.edits import COLOURS, OTHER_COLOUR, affiliation_colour
from axonframe.functions.shared import stored
from axonframe.functions.scoring import FEATURES, SomaModel, chunk_features, distance_penalty
from axonframe.operators import edits, geometry, hierarchy, lookup, maintenance, metadata, nuclei, partners, paths, skeleton, soma, training, versions, welding
from axonframe.plans.proxies import PIN, Tables, with_tables
from axonframe.sources import tables
from axonframe.streaming import edit_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A model with round numbers, for queries whose SQL states it.
MODEL = SomaModel([10.0, 3.0, 3.0, 9.0, 0.8], np.diag([0.5, 2.0, 1.5, 1.0, 0.25]).tolist(), (-200.0, 50.0), [0.004, 0.008, 0.012, 0.006, 0.004, 0.005])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# metadata


@query("SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, 'PROMO|LARGE')")
def meta_regex(t):
    return t.table("part").where(metadata.query_predicate("/p_type:PROMO|LARGE")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) = 'promo'")
def meta_fixed_icase(t):
    return t.table("part").where(metadata.query_predicate("p_type:promo", ignore_case=True, fixed=True)).select("p_partkey", "p_type")


_GOOD = with_tables("annotations") + ", good AS (SELECT * FROM annotations WHERE status IS NULL OR status NOT IN ('duplicate', 'bad_nucleus')) "


@query(_GOOD + "SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY _id) = 1")
def meta_unique(t):
    return metadata.metadata(t.annotations(), unique=True)[0]


@query(_GOOD + "SELECT * FROM good QUALIFY count(*) OVER (PARTITION BY root_id) > 1")
def meta_dups(t):
    return metadata.metadata(t.annotations(), unique=True)[1]


@query(_GOOD + "SELECT root_id FROM good WHERE class = '2-HIGH'")
def meta_ids(t):
    return metadata.ids_of(t.annotations(), "class:2-H.*")


@query(with_tables("annotations", "history") + f"SELECT a._id, coalesce(h.root_id, a.root_id) AS root_id, a.status FROM annotations a LEFT JOIN history h ON h.supervoxel_id = a.root_id AND h.supervoxel_id <> 0 AND h.valid_from <= TIMESTAMP '{PIN}' AND (h.valid_to IS NULL OR h.valid_to > TIMESTAMP '{PIN}') WHERE a.status IS NULL OR a.status NOT IN ('duplicate', 'bad_nucleus')")
def meta_at_timepoint(t):
    rows = t.annotations().withColumn("supervoxel_id", F.col("root_id"))
    return metadata.metadata(rows, history=t.history(), at=F.lit(PIN).cast("timestamp"))[0].select("_id", "root_id", "status")


@query(with_tables("hierarchy") + "SELECT root_id AS id, hemilineage AS lineage, superclass AS class, class AS subclass, subclass AS subsubclass, coalesce(instance, coalesce(type, 'NA') || '_' || coalesce(side, '')) AS instance, type, side FROM hierarchy")
def meta_standard(t):
    return metadata.common_schema(t.hierarchy())


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('5-LOW') AND regexp_matches(o_orderpriority, 'H|M') ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def annotation_scan(t):
    return metadata.scan(t.table("orders"), keep={"o_orderstatus": ["F", "P"]}, drop={"o_orderpriority": ["5-LOW"]}, regex={"o_orderpriority": "H|M"}, select=["o_orderkey", "o_custkey"], order=["o_orderkey"], offset=20, limit=50)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F')")
def sql_scan(t):
    return tables.sql_over(t.spark, "SELECT o_orderkey, o_orderstatus FROM annotation_rows WHERE o_orderstatus NOT IN ('F')", annotation_rows=t.table("orders"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def count_source(t):
    return metadata.count_by(t.table("orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query(with_tables("hierarchy") + "SELECT type, side, count(*) AS n FROM hierarchy GROUP BY 1, 2")
def count_type_side(t):
    return metadata.count_by(t.hierarchy(), "type", "side")


@query(with_tables("hierarchy") + "SELECT root_id, type, n FROM (SELECT root_id, type, count(*) OVER (PARTITION BY type, subclass) AS n FROM hierarchy) WHERE n = 2")
def add_count_filter(t):
    return metadata.add_count(t.hierarchy(), "type", "subclass").where("n = 2").select("root_id", "type", "n")


@query(with_tables("hierarchy") + "SELECT type, nullif(count(*) FILTER (side = 'L'), 0) AS L, nullif(count(*) FILTER (side = 'R'), 0) AS R FROM hierarchy GROUP BY 1")
def adjacency_pivot(t):
    return metadata.wide_counts(t.hierarchy(), "type", "side", ["L", "R"])


# partners


@query("SELECT l_suppkey AS query, l_partkey AS partner, count(*) AS weight FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) GROUP BY 1, 2 HAVING count(*) >= 2")
def partners_out(t):
    return partners.partners_at_least(t.synapses(), t.table("supplier").where("s_nationkey < 12").select("s_suppkey"), "outputs", 2)


@query("SELECT l_partkey AS query, l_suppkey AS partner, count(*) AS weight FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) GROUP BY 1, 2 HAVING count(*) > 1")
def partners_in(t):
    return partners.partner_summary(t.synapses(), t.table("part").where("p_size < 20").select("p_partkey"), "inputs", 1)


def _synapse_weights(t):
    """One row of weight 1 for each synapse: profiles sum them by group, so that pairs of neurons need no shuffle of their own."""
    return t.synapses().select(F.col("pre_root").alias("query"), F.col("post_root").alias("partner"), F.lit(1).alias("weight"))


@query("""WITH w AS (SELECT l_suppkey AS q, p_brand AS g, count(*)::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#1' GROUP BY 1, 2), n AS (SELECT q, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
    SELECT a.q AS a, b.q AS b, round(sum(a.w * b.w) / any_value(x.n * y.n), 6) AS cosine FROM w a JOIN w b ON a.g = b.g AND a.q < b.q JOIN n x ON x.q = a.q JOIN n y ON y.q = b.q GROUP BY 1, 2""")
def partner_cosine(t):
    groups = t.table("part").select(F.col("p_partkey").alias("partner"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("group"))
    return partners.cosine_similarity(_synapse_weights(t), groups, digits=6)


@query("""WITH w AS (SELECT l_suppkey AS q, l_partkey % 200 AS g, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT q, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
    SELECT a.q AS a, b.q AS b, round(sum(a.w * b.w) / any_value(x.n * y.n), 6) AS cosine FROM w a JOIN w b ON a.g = b.g AND a.q < b.q JOIN n x ON x.q = a.q JOIN n y ON y.q = b.q GROUP BY 1, 2 HAVING sum(a.w * b.w) / any_value(x.n * y.n) >= 0.8::DOUBLE""")
def partner_cosine_least(t):
    """Pairs of similar profiles, without making those that are not. The operator's bound holds to 1e-12, the query's to the last bit."""
    groups = t.table("part").select(F.col("p_partkey").alias("partner"), (F.col("p_partkey") % 200).alias("group"))
    return partners.cosine_similarity(_synapse_weights(t), groups, least=0.8).where(F.col("cosine") >= 0.8).withColumn("cosine", r6(F.col("cosine")))


# coordinates and geometry


@query("SELECT c_custkey, c_acctbal AS x, c_acctbal * 16 AS nm_x, c_nationkey * 45.0::DOUBLE AS nm_z FROM customer")
def raw_nm_roundtrip(t):
    raw = t.table("customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.lit(1.0).alias("y"), F.col("c_nationkey").cast("double").alias("z"))
    nm = coords.raw_to_nm(raw)
    back = coords.nm_to_raw(nm.withColumns({"nm_x": F.col("x"), "nm_z": F.col("z")}))
    return back.select("c_custkey", "x", "nm_x", "nm_z")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT || ',' || l_suppkey || ',' || l_linenumber AS position FROM lineitem")
def xyz_parse_format(t):
    text = F.concat(F.lit(" "), F.col("l_quantity").cast("int"), F.lit(", "), F.col("l_suppkey"), F.lit("  "), F.col("l_linenumber"))
    p = coords.parse_xyz(text)
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", coords.format_xyz(p["x"], p["y"], p["z"]).alias("position"))


@query("SELECT c_custkey, round(5000 - c_acctbal, 6) AS m_x, CASE WHEN abs((5000 - 2 * c_acctbal) / 2) < 500 THEN 'M' WHEN 5000 - 2 * c_acctbal < 0 THEN 'L' ELSE 'R' END AS side FROM customer")
def point_side(t):
    rows = t.table("customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    corners = [(x, y, z) for x in (0.0, 2000.0) for y in (0.0, 1000.0) for z in (0.0, 1000.0)]
    swap = geometry.mirror_landmarks(corners, [(5000 - x, y, z) for x, y, z in corners], raw=False)
    out = geometry.mirror(rows, "landmarks", swap=swap)
    # to a grid of 1e-6, so that a point on the threshold is not decided by the last bit of the spline
    distance = geometry.side_distance(F.col("x"), r6(F.col("m_x")))
    return out.select("c_custkey", r6(F.col("m_x")).alias("m_x"), geometry.side_of(F.round(distance, 6), 500).alias("side"))


@query("SELECT c_custkey, round(734144 - c_acctbal, 4) AS m_x FROM customer")
def mirror_flip(t):
    rows = t.table("customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.lit(10.0).alias("y"), F.lit(10.0).alias("z"))
    box = [(x, y, z) for x in (0.0, 700.0) for y in (0.0, 300.0) for z in (0.0, 200.0)]
    same = geometry.ThinPlateSpline.fit(box, box)
    return geometry.mirror(rows, "tps", "nm", same, same).select("c_custkey", F.round("m_x", 4).alias("m_x"))


_SOURCE = np.random.default_rng(1).uniform(0, 10_000, (12, 3)).round(3)
_WARP = geometry.ThinPlateSpline.fit(_SOURCE, _SOURCE + np.random.default_rng(2).normal(0, 50, (12, 3)).round(3))


def _spline_sql(axis: int) -> str:
    """One coordinate of _WARP over x, y and z."""
    number = lambda v: f"({float(v)!r}::DOUBLE)"
    terms = [f"{number(w[axis])} * sqrt((x - {number(s[0])})^2 + (y - {number(s[1])})^2 + (z - {number(s[2])})^2)" for s, w in zip(_WARP.source, _WARP.weights)]
    return " + ".join([number(_WARP.affine[0][axis]), *(f"{number(_WARP.affine[i + 1][axis])} * {c}" for i, c in enumerate("xyz")), *terms])


@query("WITH p AS (SELECT c_custkey, c_acctbal AS x, c_nationkey * 300.0::DOUBLE AS y, 10.0::DOUBLE AS z FROM customer) SELECT c_custkey, " + ", ".join(f"round({_spline_sql(i)}, 4) AS m_{a}" for i, a in enumerate("xyz")) + " FROM p")
def tps_eval(t):
    rows = t.table("customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 300.0).alias("y"), F.lit(10.0).alias("z"))
    return geometry.apply_to_points(rows, _WARP).select("c_custkey", *(F.round(f"m_{a}", 4).alias(f"m_{a}") for a in "xyz"))


@query("SELECT c_custkey, c_acctbal AS x, c_nationkey * 300.0::DOUBLE AS y, 10.0::DOUBLE AS z FROM customer")
def tps_round_trip(t):
    """Points through a curved warp and back by its inversion, as they were."""
    rows = t.table("customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 300.0).alias("y"), F.lit(10.0).alias("z"))
    back = geometry.apply_to_points(geometry.apply_to_points(rows, _WARP), _WARP.inverse(1e-9), "m_", "b")
    return back.select("c_custkey", *((F.round(f"b_{a}", 4) + 0.0).alias(a) for a in "xyz"))


def _cube(size: float) -> geometry.Mesh:
    corners = np.array([(x, y, z) for x in (0, size) for y in (0, size) for z in (0, size)], float)
    faces = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    return geometry.Mesh(corners, np.array(faces))


@query("""WITH p AS (SELECT c_custkey, c_acctbal - 1000 AS x, c_nationkey * 200.0::DOUBLE - 500 AS y, 2500.0::DOUBLE AS z FROM customer)
    SELECT c_custkey, round(CASE WHEN x > 0 AND x < 5000 AND y > 0 AND y < 5000 THEN least(x, 5000 - x, y, 5000 - y, 2500) ELSE -sqrt(greatest(-x, x - 5000, 0)^2 + greatest(-y, y - 5000, 0)^2) END, 4) + 0 AS dist_npil_nm,
    CASE WHEN x > 0 AND x < 5000 AND y > 0 AND y < 5000 THEN 'inside' WHEN greatest(-x, x - 5000, 0) + greatest(-y, y - 5000, 0) > 0 THEN 'outside' ELSE 'surface' END AS label FROM p WHERE x NOT IN (0, 5000) AND y NOT IN (0, 5000)""")
def mesh_distance(t):
    rows = t.table("customer").select("c_custkey", (F.col("c_acctbal") - 1000).alias("x"), (F.col("c_nationkey") * 200.0 - 500).alias("y"), F.lit(2500.0).alias("z")).where("x NOT IN (0, 5000) AND y NOT IN (0, 5000)")
    out = geometry.mesh_distance(rows, _cube(5000.0))
    return out.select("c_custkey", (F.round("dist_npil_nm", 4) + 0).alias("dist_npil_nm"), geometry.surface_label(F.col("dist_npil_nm")).alias("label"))


def _corner_block(size: float, cells: int) -> geometry.Mesh:
    """A block of size x size x size without its far quarter in x and y, its surface cut into squares of size / cells."""
    solid = np.zeros((cells + 2,) * 3, bool)
    solid[1:-1, 1:-1, 1:-1] = True
    solid[1 + cells // 2 :, 1 + cells // 2 :, :] = False
    corners = []
    for axis in range(3):
        u, v = np.eye(3, dtype=int)[(axis + 1) % 3], np.eye(3, dtype=int)[(axis + 2) % 3]
        step = solid.astype(np.int8) - np.roll(solid, 1, axis).astype(np.int8)
        for sign in (1, -1):
            at = np.argwhere(step == sign) - 1
            square = [at, at + (v if sign > 0 else u), at + u + v, at + (u if sign > 0 else v)]
            corners += [np.stack([square[0], square[i], square[i + 1]], axis=1) for i in (1, 2)]
    corners = np.concatenate(corners) * (size / cells)
    return geometry.Mesh(corners.reshape(-1, 3), np.arange(3 * len(corners)).reshape(-1, 3))


_SEGMENT = "greatest({u0} - {u}, {u} - {u1}, 0)^2 + ({v} - {w})^2"
_EDGES = [("x", 0, 5000, "y", 0), ("y", 0, 2500, "x", 5000), ("x", 2500, 5000, "y", 2500), ("y", 2500, 5000, "x", 2500), ("x", 0, 2500, "y", 5000), ("y", 0, 5000, "x", 0)]


@query(f"""WITH p AS (SELECT c_custkey, c_acctbal * 0.9::DOUBLE - 700 AS x, (c_custkey * 37 % 6000)::DOUBLE - 500 AS y, 100 + c_nationkey * 190.0::DOUBLE AS z FROM customer),
    d AS (SELECT *, sqrt(least({', '.join(_SEGMENT.format(u=u, u0=a, u1=b, v=v, w=w) for u, a, b, v, w in _EDGES)})) AS d, x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 5000 AND NOT (x > 2500 AND y > 2500) AS inside FROM p)
    SELECT c_custkey, round(CASE WHEN inside THEN least(d, z, 5000 - z) ELSE -d END, 3) AS dist_npil_nm FROM d WHERE d > 0.01::DOUBLE""")
def mesh_distance_concave(t):
    """Signed distances to a block with a corner cut out, of 2,400 faces; points on the surface are left out, as their sign is a matter of rounding."""
    rows = t.table("customer").select("c_custkey", (F.col("c_acctbal") * 0.9 - 700).alias("x"), ((F.col("c_custkey") * 37 % 6000).cast("double") - 500).alias("y"), (F.col("c_nationkey") * 190.0 + 100).alias("z"))
    out = geometry.mesh_distance(rows, _corner_block(5000.0, 16))
    return out.where("abs(dist_npil_nm) > 0.01").select("c_custkey", F.round("dist_npil_nm", 3).alias("dist_npil_nm"))


@query("""WITH g AS (SELECT (floor(c_acctbal / 500))::BIGINT AS cx, c_nationkey::BIGINT AS cy, min(c_custkey) AS sv FROM customer GROUP BY 1, 2), p AS (SELECT s_suppkey, nullif(s_acctbal, 73) AS x, s_nationkey AS y FROM supplier)
    SELECT s_suppkey, coalesce(CASE WHEN x IS NOT NULL THEN sv END, 0) AS segment_id FROM p LEFT JOIN g ON cx = floor(x / 500) AND cy = y""")
def xyz2id_grid(t):
    cells = t.table("customer").select(F.floor(F.col("c_acctbal") / 500).alias("cx"), F.col("c_nationkey").cast("long").alias("cy"), F.lit(0).cast("long").alias("cz"), F.col("c_custkey").alias("supervoxel_id"))
    points = t.table("supplier").select("s_suppkey", F.nullif(F.col("s_acctbal"), F.lit(73.0)).alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return lookup.points_to_segments(points, cells, (500.0, 1.0, 1.0), raw=True, root=False, integer=True).select("s_suppkey", "segment_id")


def _hierarchy(t):
    """Cells of customers, and three layers of nodes above their supervoxels: by market segment in chunks of two by two cells, by its first letter in chunks of four by four, and by nation's parity. Every seventh supervoxel skips layer 2, and half of all edges were replaced before the moment asked for."""
    place = {"cx": F.floor(F.col("c_acctbal") / 500) + 4, "cy": F.col("c_nationkey").cast("long"), "cz": F.lit(0).cast("long")}
    rows = t.table("customer").where("c_acctbal >= -2000").select("c_custkey", "c_mktsegment", "c_nationkey", *[c.alias(n) for n, c in place.items()])
    rows = rows.withColumn("chunk", chunks.morton(*(F.floor(F.col(n) / 2) for n in place)))
    number = {2: F.ascii("c_mktsegment") % 32 + 1, 3: F.ascii("c_mktsegment") % 4 + 1, 4: F.col("c_nationkey") % 2 + 1}
    node = {k: chunks.node_id(k, chunks.chunk_at(F.col("chunk"), k), n) for k, n in number.items()}
    rows = rows.select("cx", "cy", "cz", "chunk", F.col("c_custkey").alias("supervoxel_id"), *[c.alias(f"n{k}") for k, c in node.items()])
    skips = F.col("supervoxel_id") % 7 == 0
    edges = rows.select(F.col("supervoxel_id").alias("child_id"), F.when(skips, F.col("n3")).otherwise(F.col("n2")).alias("parent_id"))
    edges = edges.union(rows.select("n2", "n3").distinct()).union(rows.select("n3", "n4").distinct())
    moments = [F.lit(x).cast("timestamp") for x in ("2020-01-01", PIN, None)]
    old = edges.where("child_id % 2 = 0").select("child_id", (F.col("parent_id") + 1000).alias("parent_id"), moments[0].alias("valid_from"), moments[1].alias("valid_to"))
    return rows, edges.select("child_id", "parent_id", F.when(F.col("child_id") % 2 == 0, moments[1]).otherwise(moments[0]).alias("valid_from"), moments[2].alias("valid_to")).union(old)


_CODE = "list_sum([(({x} >> i) & 1) * (1 << (3 * i)) + (({y} >> i) & 1) * (1 << (3 * i + 1)) for i in range(10)])::BIGINT"


@query(f"""WITH c AS (SELECT c_custkey AS sv, (floor(c_acctbal / 500))::BIGINT + 4 AS cx, c_nationkey::BIGINT AS cy, ascii(c_mktsegment) AS a, c_nationkey % 2 AS p FROM customer WHERE c_acctbal >= -2000),
    m AS (SELECT *, {_CODE.format(x="(cx // 2)", y="(cy // 2)")} AS code FROM c),
    n AS (SELECT *, CASE WHEN sv % 7 = 0 THEN sv ELSE (2::BIGINT << 55) + (code << 25) + a % 32 + 1 END AS n2, (3::BIGINT << 55) + ((code >> 3) << 25) + a % 4 + 1 AS n3, (4::BIGINT << 55) + ((code >> 6) << 25) + p + 1 AS n4 FROM m),
    g AS (SELECT cx, cy, arg_min(n, sv) AS n FROM n GROUP BY 1, 2),
    up AS (SELECT b, min(t) AS t FROM (SELECT (2::BIGINT << 55) + (code << 25) + a % 32 + 1 AS b, n3 AS t FROM n) GROUP BY 1), top AS (SELECT n3 AS b, min(n4) AS t FROM n GROUP BY 1),
    q AS (SELECT s_suppkey, (floor(s_acctbal / 500))::BIGINT + 4 AS cx, s_nationkey AS cy FROM supplier)
    SELECT s_suppkey, coalesce(g.n.sv, 0) AS layer_1, coalesce(g.n.n2, 0) AS layer_2, coalesce(CASE WHEN g.n.sv % 7 = 0 THEN g.n.n3 ELSE up.t END, 0) AS layer_3, coalesce(top.t, 0) AS root
    FROM q LEFT JOIN g ON g.cx = q.cx AND g.cy = q.cy LEFT JOIN up ON up.b = g.n.n2 LEFT JOIN top ON top.b = CASE WHEN g.n.sv % 7 = 0 THEN g.n.n3 ELSE up.t END""")
def xyz2id_layers(t):
    """Supervoxel, level-2 chunk, layer-3 node and root of points, at one moment."""
    cells, parents = _hierarchy(t)
    nodes = hierarchy.layer_nodes(cells, parents, 3, F.lit(PIN).cast("timestamp"))
    points = t.table("supplier").select("s_suppkey", (F.floor(F.col("s_acctbal") / 500) + 4).cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    for layer, name in ((1, "layer_1"), (2, "layer_2"), (3, "layer_3"), (None, "root")):
        points = lookup.points_to_segments(points, cells, raw=True, integer=True, stop_layer=layer, nodes=nodes, chunk_cells=(2, 2, 2)).withColumnRenamed("segment_id", name)
    return points.drop("x", "y", "z")


@query(with_tables("chunks") + "SELECT root_id, l2_id, (rep_coord_nm_x - 250)^2 + (rep_coord_nm_y - 50)^2 + (rep_coord_nm_z - 90)^2 AS d2 FROM chunks QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY d2, l2_id) = 1")
def nearest_chunk(t):
    points = t.table("orders").select(F.col("o_orderkey").alias("root_id"), F.lit(250.0).alias("px"), F.lit(50.0).alias("py"), F.lit(90.0).alias("pz"))
    return training.positives(t.chunks(), points).select("root_id", "l2_id", "d2")


# versions


@query(with_tables("history") + f"SELECT c_custkey, coalesce(h.root_id, 0) AS root_id FROM customer LEFT JOIN history h ON h.supervoxel_id = c_custkey AND h.supervoxel_id <> 0 AND h.valid_from <= TIMESTAMP '{PIN}' AND (h.valid_to IS NULL OR h.valid_to > TIMESTAMP '{PIN}')")
def rootid_asof(t):
    rows = t.table("customer").select("c_custkey", F.lit(0).cast("long").alias("root_id"))
    return versions.root_at(rows, t.history(), F.lit(PIN).cast("timestamp"), supervoxel="c_custkey")


@query(with_tables("history") + f"SELECT DISTINCT supervoxel_id AS root_id, root_id AS latest_id FROM history WHERE valid_from <= TIMESTAMP '{PIN}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{PIN}')")
def latest_id(t):
    lineage = t.history().select(F.col("supervoxel_id").alias("root_id"), F.col("root_id").alias("new_id"), "valid_from", "valid_to")
    at = F.lit(PIN).cast("timestamp")
    ids = lineage.where((F.col("valid_from") <= at)).select("root_id").distinct()
    return versions.latest_ids(ids, lineage, at)


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS a, event_id + 1 AS b, 0.7::DOUBLE AS share FROM events WHERE event_id % 23 <> 0 AND ts <= TIMESTAMP '{PIN}' UNION ALL SELECT event_id, event_id + 3, CASE WHEN event_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.3 END FROM events WHERE event_id % 23 <> 0 AND event_id % 5 = 0 AND ts <= TIMESTAMP '{PIN}'
    UNION ALL SELECT event_id, event_id + 2, 0.7 FROM events WHERE event_id % 23 <> 0 AND event_id % 7 = 0 AND ts <= TIMESTAMP '{PIN}'), heir AS (SELECT a, arg_max(b, (share, -b)) AS b FROM e GROUP BY 1),
    walk AS (SELECT event_id AS root_id, event_id AS here FROM events UNION ALL SELECT root_id, heir.b FROM walk JOIN heir ON heir.a = walk.here) SELECT root_id, max(here) AS latest_id FROM walk GROUP BY 1""")
def latest_id_chain(t):
    """Ids after chains of up to 23 edits, with splits into a larger, a lesser and an equal part, and merges where their ends meet."""
    log = t.table("events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    step = lambda rows, by, share: rows.where("event_id % 23 <> 0").select(F.col("event_id").alias("old_id"), (F.col("event_id") + by).alias("new_id"), "timestamp", share.alias("share"))
    lesser = F.when(F.col("event_id") % 2 == 0, 0.9).otherwise(0.3)
    edited = step(log, 1, F.lit(0.7)).union(step(log.where("event_id % 5 = 0"), 3, lesser)).union(step(log.where("event_id % 7 = 0"), 2, F.lit(0.7)))
    return versions.current_ids(log.select(F.col("event_id").alias("root_id")), edited, F.lit(PIN).cast("timestamp"))


@query(f"SELECT user_id, event_id, event_type, value FROM events WHERE ts <= TIMESTAMP '{PIN}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def snapshot_latest(t):
    return versions.snapshot(t.table("events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], F.lit(PIN).cast("timestamp"), tie="event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT DISTINCT o_custkey AS root_id FROM orders WHERE o_custkey <> 0")
def normalised_ids(t):
    return versions.normalise_ids(t.table("orders").select(F.col("o_custkey").cast("string").alias("root_id")), unique=True, drop_zero=True)


# nuclei and somata

_NUCLEI = with_tables("nuclei") + """, d AS (SELECT root_id, position, max(volume) AS v, arg_min(id, (-volume, id)) AS nucleus_id FROM nuclei WHERE root_id IS NOT NULL AND position IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, count(*) OVER (PARTITION BY root_id) AS n_nuclei, row_number() OVER (PARTITION BY root_id ORDER BY v DESC, nucleus_id) AS size_rank FROM d) """


@query(_NUCLEI + "SELECT root_id, position, 'nucleus' AS source, n_nuclei::INT AS n_nuclei, nucleus_id FROM k WHERE size_rank = 1")
def nuclei_largest(t):
    return nuclei.dedup_nuclei(t.nuclei())


@query(_NUCLEI + "SELECT root_id, position, 'nucleus' AS source, n_nuclei::INT AS n_nuclei, nucleus_id, size_rank::INT AS size_rank FROM k")
def nuclei_all(t):
    return nuclei.dedup_nuclei(t.nuclei(), "all")


@query(_NUCLEI + """, a AS (SELECT o_custkey AS root_id, (o_orderkey % 90) * 16 || ',' || 16 || ',' || 45 AS position FROM orders WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
    SELECT c_custkey AS ordinal, c_custkey AS root_id, coalesce(a.position, k.position) AS position, CASE WHEN a.root_id IS NOT NULL THEN 'annotation' WHEN k.root_id IS NOT NULL THEN 'nucleus' END AS source, CASE WHEN a.root_id IS NULL THEN k.n_nuclei::INT END AS n_nuclei
    FROM customer LEFT JOIN a ON a.root_id = c_custkey LEFT JOIN k ON k.root_id = c_custkey AND size_rank = 1""")
def soma_cascade(t):
    text = F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(",1,1"))
    annotated = t.table("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("root_id"), text.alias("soma_xyz"))
    ids = t.table("customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("root_id"))
    return soma.soma_positions(ids, annotations=annotated, nuclei=t.nuclei().withColumn("id", F.col("id").cast("int"))).select("ordinal", "root_id", "position", "source", "n_nuclei")


@query(with_tables("neurons") + "SELECT root_id, coalesce(CASE WHEN upper(side) IN ('L', 'R', 'M', 'U') THEN upper(side) END, CASE WHEN 4000 - 2 * x < 0 THEN 'L' ELSE 'R' END) AS side FROM neurons")
def soma_side_auto(t):
    rows = t.neurons()
    return soma.soma_sides(rows.select("root_id"), rows, rows.select("root_id", "x", (4000 - F.col("x")).alias("m_x")))


_FEATURES = with_tables("features")
_SHAPE = "0.5::DOUBLE * (log_area - 10)^2 + 2 * (log_size - 3)^2 + 1.5::DOUBLE * (log_max_dt - 3)^2 + (log_mean_dt - 9)^2 + 0.25::DOUBLE * (roundness - 0.8)^2"


@query(_FEATURES + "SELECT root_id, l2_id, round(log_area, 6) AS log_area, round(log_size, 6) AS log_size, round(log_max_dt, 6) AS log_max_dt, round(log_mean_dt, 6) AS log_mean_dt, round(roundness, 6) AS roundness FROM features")
def l2_features(t):
    return t.chunks().select("root_id", "l2_id", *[r6(c).alias(n) for n, c in chunk_features().items()])


@query(_FEATURES + f"SELECT root_id, l2_id, round({_SHAPE}, 6) AS soma_score FROM features WHERE pca_val_0 > 0")
def l2_mahalanobis(t):
    return soma.score_chunks(t.chunks(), MODEL).select("root_id", "l2_id", r6(F.col("soma_score")).alias("soma_score"))


@query("""WITH g AS (SELECT [0.004, 0.008, 0.012, 0.006, 0.004, 0.005]::DOUBLE[] AS g), d AS (SELECT c_custkey, c_acctbal / 20 - 300 AS um FROM customer), i AS (SELECT *, (um + 200) / 50 AS pos, least(floor((um + 200) / 50), 4)::INT AS i FROM d)
    SELECT c_custkey, round(-2 * ln((CASE WHEN um BETWEEN -200 AND 50 THEN g[i + 1] + (g[i + 2] - g[i + 1]) * (pos - i) ELSE 4e-6::DOUBLE END) / 0.012::DOUBLE), 6) AS penalty FROM i, g""")
def l2_penalty(t):
    return t.table("customer").select("c_custkey", r6(distance_penalty(MODEL, F.col("c_acctbal") / 20 - 300)).alias("penalty"))


@query(_FEATURES + f", s AS (SELECT root_id, l2_id, {_SHAPE} AS score FROM features WHERE pca_val_0 > 0) SELECT root_id, l2_id, round(score, 6) AS soma_score FROM s QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY score NULLS LAST, l2_id) = 1")
def l2_top1(t):
    chunks = t.chunks()
    return soma.best_chunks(chunks.select("root_id", "l2_id"), chunks.drop("root_id"), MODEL).select("root_id", "l2_id", r6(F.col("soma_score")).alias("soma_score"))


#: Chunks a thousand times farther apart, and a cube to measure them from.
_SIDE = 200_000.0
_FAR = _FEATURES + """, far AS (SELECT f.root_id, f.l2_id, f.log_area, f.log_size, f.log_max_dt, f.log_mean_dt, f.roundness, f.pca_val_0, c.rep_coord_nm_x * 1000 AS x, c.rep_coord_nm_y * 1000 AS y, c.rep_coord_nm_z * 1000 AS z FROM features f JOIN chunks c USING (root_id, l2_id)),
    """
_CUBE_DISTANCE = "CASE WHEN least(x, y, z) > 0 AND greatest(x, y, z) < 200000 THEN least(x, y, z, 200000 - x, 200000 - y, 200000 - z) ELSE -sqrt(greatest(-x, x - 200000, 0)^2 + greatest(-y, y - 200000, 0)^2 + greatest(-z, z - 200000, 0)^2) END"
_PENALTY = "-2 * ln(greatest(CASE WHEN um BETWEEN -200 AND 50 THEN g[least(floor((um + 200) / 50), 4)::INT + 1] + (g[least(floor((um + 200) / 50), 4)::INT + 2] - g[least(floor((um + 200) / 50), 4)::INT + 1]) * ((um + 200) / 50 - least(floor((um + 200) / 50), 4)) ELSE 4e-6::DOUBLE END, 2.2250738585072014e-308::DOUBLE) / 0.012::DOUBLE)"
_SCORED = _FAR + f"g AS (SELECT [0.004, 0.008, 0.012, 0.006, 0.004, 0.005]::DOUBLE[] AS g), m AS (SELECT *, {_CUBE_DISTANCE} AS d, ({_CUBE_DISTANCE}) / 1000 AS um FROM far), s AS (SELECT *, {_SHAPE} AS shape, {_PENALTY} AS penalty FROM m, g WHERE pca_val_0 > 0) "


def _far_chunks(t):
    return t.chunks().withColumns({f"rep_coord_nm_{a}": F.col(f"rep_coord_nm_{a}") * 1000 for a in "xyz"})


@query(_SCORED + "SELECT root_id, l2_id, round(d, 3) + 0 AS dist_npil_nm, round(shape + penalty, 6) AS soma_score FROM s")
def soma_score_sum(t):
    """Shape and distance together."""
    out = soma.score_chunks(_far_chunks(t), MODEL, _cube(_SIDE), "l2+mesh")
    return out.select("root_id", "l2_id", (F.round("dist_npil_nm", 3) + 0).alias("dist_npil_nm"), r6(F.col("soma_score")).alias("soma_score"))


def _by_chunks(t, method):
    chunks = _far_chunks(t)
    ids = t.table("orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("root_id"))
    out = soma.soma_positions(ids, method, membership=chunks.select("root_id", "l2_id"), attributes=chunks.drop("root_id"), model=MODEL, mesh=None if method == "l2" else _cube(_SIDE))
    return out.select("ordinal", "root_id", "position", "source", (r6(F.col("soma_score")) + 0).alias("soma_score"), (F.round("dist_npil_nm", 3) + 0).alias("dist_npil_nm"), "l2_id")


def _best_sql(score: str, source: str, distance: str) -> str:
    number = lambda c: f"{c}::BIGINT::VARCHAR"
    place = f"{number('x')} || ',' || {number('y')} || ',' || {number('z')}"
    return _SCORED + f""", best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY {score} NULLS LAST, l2_id) = 1)
    SELECT o_orderkey AS ordinal, o_orderkey AS root_id, CASE WHEN l2_id IS NOT NULL THEN {place} END AS position, CASE WHEN l2_id IS NOT NULL THEN '{source}' END AS source, round({score}, 6) + 0 AS soma_score, {distance} AS dist_npil_nm, l2_id FROM orders LEFT JOIN best ON root_id = o_orderkey"""


@query(_best_sql("shape", "l2", "NULL::DOUBLE"))
def soma_l2(t):
    return _by_chunks(t, "l2")


@query(_best_sql("penalty", "mesh", "round(d, 3) + 0"))
def soma_mesh(t):
    return _by_chunks(t, "mesh")


@query(_best_sql("shape + penalty", "l2+mesh", "round(d, 3) + 0"))
def soma_l2_mesh(t):
    """The cascade where neither annotations nor nuclei know a root: the best chunk by shape and distance."""
    return _by_chunks(t, "auto")


_NODES = f"""c AS (SELECT c_custkey AS sv, (floor(c_acctbal / 500))::BIGINT + 4 AS cx, c_nationkey::BIGINT AS cy, ascii(c_mktsegment) AS a FROM customer WHERE c_acctbal >= -2000),
    m2 AS (SELECT *, {_CODE.format(x="(cx // 2)", y="(cy // 2)")} AS code FROM c), n2 AS (SELECT cx, cy, arg_min(CASE WHEN sv % 7 = 0 THEN sv ELSE (2::BIGINT << 55) + (code << 25) + a % 32 + 1 END, sv) AS l2 FROM m2 GROUP BY 1, 2)"""


@query(f"""WITH {_NODES}, p AS (SELECT c_custkey AS root_id, floor(c_acctbal / 500) + 4 AS x, c_nationkey::DOUBLE AS y, 0.0::DOUBLE AS z, nullif(l2, 0) AS l2 FROM customer LEFT JOIN n2 ON cx = floor(c_acctbal / 500) + 4 AND cy = c_nationkey),
    q AS (SELECT root_id, x::BIGINT::VARCHAR || ',' || y::BIGINT::VARCHAR || ',0' AS position, l2, x * 10000 AS x, y * 10000 AS y, 100000.0::DOUBLE AS z FROM p), g AS (SELECT [0.004, 0.008, 0.012, 0.006, 0.004, 0.005]::DOUBLE[] AS g),
    f AS (SELECT *, l2 % 997 + 1 AS area, ln(2 + l2 % 997) AS log_area, ln(2 + l2 % 89) AS log_size, ln(2 + l2 % 41) AS log_max_dt, ln(2 + l2 % 31) AS log_mean_dt, (l2 % 7) / 10.0::DOUBLE AS roundness, (l2 % 300)::DOUBLE * 1000 AS ax FROM q),
    h AS (SELECT * EXCLUDE (x, y, z), ax AS x, 50000.0::DOUBLE AS y, 50000.0::DOUBLE AS z FROM f), s AS (SELECT *, ({_CUBE_DISTANCE}) / 1000 AS um FROM h)
    SELECT root_id, position, l2 AS l2_id, round({_SHAPE} + {_PENALTY}, 6) AS soma_score FROM s, g""")
def soma_known(t):
    """Annotated somata with the level-2 chunks that they lie in, and those chunks' scores."""
    cells, parents = _hierarchy(t)
    cells = stored(cells, "cells")
    space = lookup.Space(cells, stored(hierarchy.layer_nodes(cells, parents, 2, F.lit(PIN).cast("timestamp")), "nodes"), chunk_cells=(2, 2, 2))
    i = F.col("l2_id")
    asked = space.nodes.where("layer = 2").select(F.col("node_id").alias("l2_id")).distinct()
    attributes = asked.select("l2_id", (i % 300 * 1000.0).alias("rep_coord_nm_x"), F.lit(50000.0).alias("rep_coord_nm_y"), F.lit(50000.0).alias("rep_coord_nm_z"), (i % 997 + 1).alias("area_nm2"), (i % 89 + 1).alias("size_nm3"), (i % 41 + 1).alias("max_dt_nm"), (i % 31 + 1).alias("mean_dt_nm"), F.lit(1.0).alias("pca_val_0"), (i % 7 / 10.0).alias("pca_val_2"))
    attributes = stored(attributes, "attributes")  # a table, as a service keeps it; as six expressions of one column its conditions would multiply in the planner
    place = F.concat_ws(",", (F.floor(F.col("c_acctbal") / 500) + 4).cast("string"), F.col("c_nationkey").cast("string"), F.lit("0"))
    annotated = t.table("customer").select(F.col("c_custkey").alias("_id"), F.col("c_custkey").alias("root_id"), place.alias("soma_xyz"))
    ids = annotated.select(F.col("_id").alias("ordinal"), "root_id")
    out = soma.soma_positions(ids, annotations=annotated, model=MODEL, attributes=attributes, mesh=_cube(_SIDE), space=space, voxel=(1.0, 1.0, 1.0))
    return out.select("root_id", "position", "l2_id", r6(F.col("soma_score")).alias("soma_score"))


@query("WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0) SELECT count(*) FILTER (o_custkey IS NULL) AS missing, count(*) AS total FROM customer LEFT JOIN a ON o_custkey = c_custkey")
def neurons_unplaced(t):
    """How many neurons could not be hung from their somata."""
    ids = t.table("customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("root_id"))
    annotated = t.table("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("root_id"), F.lit("1,2,3").alias("soma_xyz"))
    somata = soma.soma_positions(ids, annotations=annotated)
    return skeleton.unplaced(skeleton.read_neurons(t.skeletons(), ids, somata.drop("ordinal"))[1])


# edit log


@query("SELECT event_id::INT AS operation_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 1")
def ops_to_fetch(t):
    log = t.log().select("operation_id")
    return edits.to_fetch(log, log.where("operation_id % 3 = 0"), log.where("operation_id % 5 = 1"))


@query("SELECT event_id::INT AS operation_id FROM events WHERE event_id % 4 = 1")
def ops_new_missing(t):
    log = t.log().select("operation_id")
    return edits.new_missing(log, log.where("operation_id % 4 <> 1"))


@query("SELECT event_id AS id, user_id, NULL::VARCHAR AS event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_id % 2 = 1")
def ops_union_fill(t):
    e = t.table("events").withColumnRenamed("event_id", "id")
    return edits.union_fill(e.where("id % 2 = 0").select("id", "user_id"), e.where("id % 2 = 1").select("id", "event_type"))


@query("SELECT event_id::INT AS operation_id, user_id AS user FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def ops_seed_cache(t):
    log = t.log().select("operation_id", "user")
    return edits.seed_cache(log.where("operation_id % 2 = 0"), log.where("operation_id % 3 = 0"))


@query("SELECT o_orderkey AS ordinal, (o_orderkey * 7 % m)::INT AS operation_id, user_id AS user FROM orders, (SELECT max(event_id) + 1 AS m FROM events) JOIN events ON event_id = o_orderkey * 7 % m WHERE event_id % 3 <> 0")
def ops_requested_order(t):
    """Requests that come back to the same ids again and again, over the whole log."""
    top = edits.last_operation(t.log())
    wanted = t.table("orders").join(F.broadcast(top)).select(F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") * 7 % (F.col("last_operation") + 1)).cast("int").alias("operation_id"))
    return edits.in_requested_order(wanted, t.log().where("operation_id % 3 <> 0").select("operation_id", "user"))


@query("SELECT o_orderkey AS ordinal, (o_orderkey * 7)::INT AS operation_id, user_id AS user FROM orders JOIN events ON event_id = o_orderkey * 7 WHERE event_id % 3 <> 0")
def ops_requested_order_whole(t):
    wanted = t.table("orders").select(F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") * 7).cast("int").alias("operation_id"))
    return edits.in_requested_order(wanted, t.log().where("operation_id % 3 <> 0").select("operation_id", "user"))


@query("SELECT event_id::INT AS operation_id, user_id::VARCHAR AS user, event_type AS status FROM events")
def ops_from_json(t):
    q = F.lit('"')
    text = F.concat(F.lit('{"'), "event_id", F.lit('": {"user": "'), "user_id", F.lit('", "status": "'), "event_type", q, F.lit("}}"))
    return edits.details_from_json(t.table("events").select(text.alias("json"))).select("operation_id", "user", "status")


@query("""SELECT event_id::INT AS operation_id, CASE WHEN event_id % 7 <> 0 THEN (event_id % 10 + event_id % 11) / 2.0::DOUBLE END AS sink_x, CASE WHEN event_id % 7 <> 0 THEN (event_id % 12 + event_id % 13) / 2.0::DOUBLE END AS sink_y,
    CASE WHEN event_id % 7 <> 0 THEN (event_id % 14 + event_id % 15) / 2.0::DOUBLE END AS sink_z, CASE WHEN event_id % 5 <> 0 THEN (event_id % 17)::DOUBLE END AS source_y FROM events""")
def ops_centroid(t):
    return edits.add_centroids(t.log()).select("operation_id", "sink_x", "sink_y", "sink_z", "source_y")


@query("SELECT max(event_id)::INT AS last_operation FROM events WHERE event_id >= 1")
def ops_last(t):
    return edits.last_operation(t.log(), 1)


@query("SELECT max(event_id)::INT AS last_operation FROM events")
def ops_last_whole(t):
    return edits.last_operation(t.log())


@query("SELECT o_orderkey::INT AS operation_id, o_orderkey IN (SELECT event_id FROM events WHERE event_id % 2 = 0) AS found FROM orders")
def ops_exists(t):
    return edits.exists(t.log().where("operation_id % 2 = 0"), t.table("orders").select(F.col("o_orderkey").cast("int").alias("operation_id")))


@query("SELECT event_id::INT AS operation_id, user_id AS user, CASE WHEN event_id % 7 <> 0 THEN (event_id % 10 + event_id % 11) / 2.0::DOUBLE END AS sink_x FROM events WHERE event_id >= 1")
def ops_all(t):
    return edits.all_operations(t.log(), centroids=True).select("operation_id", "user", "sink_x")


@query("SELECT event_id::INT AS operation_id, user_id AS user FROM events WHERE event_id >= 1")
def ops_all_whole(t):
    return edits.all_operations(t.log()).select("operation_id", "user")


@query("SELECT event_id::INT AS operation_id, place, (place - 1) // 50 + 1 AS batch FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events)")
def ops_batches(t):
    """Edits in order of time, in batches of 50 as a service takes them."""
    return edits.batches(t.log(), ["timestamp", "operation_id"], 50).select("operation_id", "place", "batch")


@query("SELECT event_id::INT AS operation_id, n_name FROM events LEFT JOIN nation ON user_id = n_nationkey")
def ops_users(t):
    users = t.table("nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name")
    return edits.with_users(t.log(), users).select("operation_id", "n_name")


_COLOUR = f"CASE {' '.join(f"WHEN regexp_matches(user_affiliation, '{pattern}') THEN '{colour}'" for pattern, colour in COLOURS)} ELSE '{OTHER_COLOUR}' END"


@query(with_tables("log") + f"SELECT operation_id, {_COLOUR} AS colour FROM log")
def ops_colour(t):
    return t.log().select("operation_id", affiliation_colour(F.col("user_affiliation")).alias("colour"))


_FRAMES = with_tables("log") + """, b AS (SELECT epoch_us(min(timestamp)) AS a, epoch_us(max(timestamp)) AS z FROM log), f AS (SELECT operation_id, user_affiliation, least(300, ((epoch_us(timestamp) - a) * 300) // (z - a) + 1)::INT AS frame FROM log, b) """


@query(_FRAMES + f"SELECT operation_id, frame, {_COLOUR} AS colour FROM f")
def ops_frames(t):
    return edits.movie_points(t.log()).select("operation_id", "frame", "colour")


@query(_FRAMES + ", n AS (SELECT frame, count(*) AS n FROM f GROUP BY 1) SELECT frame, n, (sum(n) OVER (ORDER BY frame))::BIGINT AS shown, frame / 300.0::DOUBLE AS progress FROM n")
def ops_frames_cum(t):
    return edits.movie_frames(edits.movie_points(t.log()), 300)


@query("SELECT min(value) AS min_value, max(value) AS max_value, min(user_id) AS min_user_id, max(user_id) AS max_user_id FROM events")
def ops_bbox(t):
    return edits.bounding_box(t.table("events"), "value", "user_id")


@query(with_tables("log") + f"SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', timestamp) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", {_COLOUR} AS colour, count(*) AS n FROM log GROUP BY ALL")
def ops_windows(t):
    counts = edit_stream.windowed_counts(t.log())
    return counts.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")], "colour", "n")


@query(with_tables("log") + """, g AS (SELECT user, timestamp, CASE WHEN timestamp < lag(timestamp) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY user ORDER BY timestamp)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user, epoch_us(min(timestamp)) AS start, epoch_us(max(timestamp)) + 10800000000 AS "end", count(*) AS n FROM s GROUP BY user, session""")
def ops_sessions(t):
    sessions = edit_stream.edit_sessions(t.log(), "3 hours")
    return sessions.select("user", *[F.unix_micros(c).alias(c) for c in ("start", "end")], "n")


# maintenance


@query(with_tables("annotations") + "SELECT _id, root_id, status, coalesce(status, '') <> 'duplicate' AND count(*) FILTER (coalesce(status, '') <> 'duplicate') OVER (PARTITION BY root_id) > 1 AS root_duplicated FROM annotations")
def root_duplicated(t):
    return maintenance.flag_duplicates(t.annotations()).select("_id", "root_id", "status", "root_duplicated")


def _edited(t):
    rows = t.annotations().withColumn("price", F.when(F.col("_id") % 5 == 0, None).otherwise(F.col("price")))
    return rows, rows.withColumns({"status": F.when(F.col("_id") % 4 == 0, None).when(F.col("_id") % 4 == 1, "new").otherwise(F.col("status")), "price": F.when(F.col("_id") % 10 == 0, 1.0).otherwise(F.col("price"))})


@query(with_tables("annotations") + "SELECT _id, CASE _id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'new' ELSE status END AS status FROM annotations WHERE (_id % 4 = 1) OR (_id % 10 = 0)")
def changed_rows(t):
    return maintenance.changed_rows(*_edited(t), ["status", "price"]).select("_id", "status")


@query(with_tables("annotations", "history") + f"SELECT a._id, coalesce(h.root_id, a.root_id) AS root_id FROM annotations a LEFT JOIN history h ON h.supervoxel_id = a.root_id AND h.supervoxel_id <> 0 AND h.valid_from <= TIMESTAMP '{PIN}' AND (h.valid_to IS NULL OR h.valid_to > TIMESTAMP '{PIN}')")
def update_ids(t):
    rows = t.annotations().withColumn("supervoxel_id", F.when(F.col("_id") % 2 == 0, F.col("root_id")))
    found = t.annotations().select("_id", F.col("root_id").alias("found"))
    return maintenance.sequential_update(rows, t.history(), F.lit(PIN).cast("timestamp"), found).select("_id", "root_id")


@query("""WITH s AS (SELECT o_orderkey AS _id, CASE WHEN o_orderkey % 3 <> 0 THEN printf('%06d', o_orderkey) END AS serial_id FROM orders), m AS (SELECT max(serial_id::BIGINT) AS top FROM s)
    SELECT _id, serial_id FROM s WHERE serial_id IS NOT NULL UNION ALL SELECT _id, printf('%06d', top + row_number() OVER (ORDER BY _id)) FROM s, m WHERE serial_id IS NULL""")
def assign_serial(t):
    rows = t.table("orders").select(F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderkey") % 3 != 0, F.format_string("%06d", "o_orderkey")).alias("serial_id"))
    return maintenance.assign_serials(rows)


_WANTED = "(SELECT DISTINCT c_custkey AS root_id FROM customer WHERE c_custkey <> 0)"


@query(with_tables("annotations") + f"SELECT _id, a.root_id, 'KC' AS cell_class FROM annotations a JOIN {_WANTED} w ON a.root_id = w.root_id")
def upsert_existing(t):
    return maintenance.add_neurons(t.annotations(), t.table("customer").select(F.col("c_custkey").alias("root_id")), strict=False, cell_class="KC")["up"]


@query(with_tables("annotations") + f"SELECT root_id, 'KC' AS cell_class, '1,2,' || root_id AS point_xyz FROM {_WANTED} WHERE root_id NOT IN (SELECT root_id FROM annotations)")
def upsert_new(t):
    ids = t.table("customer").select(F.col("c_custkey").alias("root_id"))
    points = ids.select("root_id", F.concat(F.lit("1,2,"), "root_id").alias("point_xyz"))
    return maintenance.add_neurons(t.annotations(), ids, points, strict=False, cell_class="KC")["new"]


@query("SELECT c_custkey + 1000000000 AS root_id, 'KC' AS cell_class, '1,2,' || (c_custkey + 1000000000) AS point_xyz FROM customer WHERE c_custkey % 2 = 1")
def upsert_new_ids(t):
    """Half of the ids are in the table, half are new."""
    ids = t.table("customer").select(F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey") + 1_000_000_000).otherwise(F.col("c_custkey")).alias("root_id"))
    known = t.table("customer").select(F.col("c_custkey").alias("_id"), F.col("c_custkey").alias("root_id"))
    points = ids.select("root_id", F.concat(F.lit("1,2,"), "root_id").alias("point_xyz"))
    return maintenance.add_neurons(known, ids, points, cell_class="KC")["new"]


@query(with_tables("annotations") + "SELECT _id, CASE WHEN _id % 2 = 0 THEN 'seen' ELSE status END AS status FROM annotations UNION ALL SELECT -1 - o_orderkey, 'seen' FROM orders WHERE o_orderkey % 2 = 0")
def upsert_rows(t):
    table = t.annotations().select("_id", "status")
    rows = table.where("_id % 2 = 0").select("_id", F.lit("seen").alias("status"))
    return maintenance.upsert(table, rows.union(rows.select(-1 - F.col("_id"), "status")), append=True)


# model fitting

_EXAMPLES = _FEATURES + ", e AS (SELECT *, CASE WHEN l2_id % 3 = 1 THEN 1 ELSE 0 END AS label FROM features WHERE log_area IS NOT NULL AND log_size IS NOT NULL AND log_max_dt IS NOT NULL AND log_mean_dt IS NOT NULL AND roundness IS NOT NULL) "


def _examples(t):
    """All chunks, in three classes: positives, hard and soft negatives."""
    chunks = t.chunks()
    return training.examples(*(chunks.where(f"l2_id % 3 = {k}") for k in (1, 2, 0)))


@query(_EXAMPLES + "SELECT label, count(*) AS n FROM e GROUP BY 1")
def train_labels(t):
    return metadata.count_by(_examples(t), "label")


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]


@query(_EXAMPLES + "SELECT " + ", ".join([f"round(avg({f}), 5) AS mean_{f}" for f in FEATURES] + [f"round(covar_samp({a}, {b}), 5) AS cov_{a}_{b}" for a, b in _PAIRS]) + ", count(*) AS n FROM e WHERE label = 1")
def train_moments(t):
    m = training.moments(_examples(t).where("label = 1"))
    return m.select(*[F.round(c, 5).alias(c) if c != "n" else F.col(c) for c in m.columns])


@query(_EXAMPLES + "SELECT " + ", ".join(f"round(quantile_cont({f}, {q}), 6) AS {f}_{int(round(q * 100))}" for f in FEATURES for q in training.QUANTILES) + " FROM e WHERE label = 1")
def train_quantiles(t):
    q = training.quantiles(_examples(t).where("label = 1"))
    return q.select(*[r6(F.col(f)[i]).alias(f"{f}_{int(round(p * 100))}") for f in FEATURES for i, p in enumerate(training.QUANTILES)])


@query("""WITH v AS (SELECT c_acctbal / 40 - 200 AS v FROM customer WHERE c_acctbal / 40 - 200 BETWEEN -200 AND 50), g AS (SELECT -200 + i * 250.0::DOUBLE / 63 AS pos FROM range(64) r(i))
    SELECT round(pos, 6) AS "at", round(0.999::DOUBLE * sum(exp(-0.5::DOUBLE * ((pos - v) / 10)^2)) / ((SELECT count(*) FROM v) * 10 * sqrt(2 * pi())) + 4e-6::DOUBLE, 9) AS density FROM g, v GROUP BY pos""")
def kde_grid(t):
    rows = t.table("customer").select((F.col("c_acctbal") / 40 - 200).alias("v"))
    return training.mixed_density(training.kde(rows, "v", points=64, width=10.0)).select(r6(F.col("at")).alias("at"), F.round("density", 9).alias("density"))


@query("""WITH v AS (SELECT c_acctbal / 40 - 200 AS v FROM customer WHERE c_acctbal / 40 - 200 BETWEEN -200 AND 50), g AS (SELECT -200 + i * 250.0::DOUBLE / 31 AS pos FROM range(32) r(i)),
    h AS (SELECT 0.9::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::DOUBLE) * count(*) ^ -0.2::DOUBLE AS h, count(*) AS n FROM v)
    SELECT round(pos, 6) AS "at", round(sum(exp(-0.5::DOUBLE * ((pos - v) / h)^2)) / any_value(n * h * sqrt(2 * pi())), 9) AS density FROM g, v, h GROUP BY pos""")
def kde_bandwidth(t):
    """The density with the width of the rule, from exact quartiles."""
    rows = t.table("customer").select((F.col("c_acctbal") / 40 - 200).alias("v"))
    return training.kde(rows, "v", points=32).select(r6(F.col("at")).alias("at"), F.round("density", 9).alias("density"))


@query(with_tables("chunks") + "SELECT root_id, l2_id FROM chunks QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY sha256(l2_id || ':20260524'), l2_id) <= 3")
def soft_negative_sample(t):
    return training.soft_negatives(t.chunks().select("root_id", "l2_id"), per_root=3)


# trees and meshes


@query(with_tables("skeletons") + """, d AS (SELECT root_id, node, count(*)::INT AS degree FROM (SELECT root_id, node_id AS node FROM skeletons WHERE parent_id <> -1 UNION ALL SELECT root_id, parent_id FROM skeletons WHERE parent_id <> -1) GROUP BY 1, 2)
    SELECT s.root_id, node_id, coalesce(degree, 0) AS degree, CASE WHEN coalesce(degree, 0) <= 1 THEN 'end' WHEN degree >= 3 THEN 'branch' ELSE 'slab' END AS kind, parent_id = -1 AS is_root FROM skeletons s LEFT JOIN d ON d.root_id = s.root_id AND node = node_id""")
def tree_endpoints(t):
    return skeleton.degrees(t.skeletons()).select("root_id", "node_id", "degree", "kind", "is_root")


@query(with_tables("skeletons") + "SELECT c.root_id, count(*) AS n_nodes, round(sum(sqrt(coalesce((c.x - p.x)^2 + (c.y - p.y)^2 + (c.z - p.z)^2, 0))), 4) AS length FROM skeletons c LEFT JOIN skeletons p ON p.root_id = c.root_id AND p.node_id = c.parent_id GROUP BY 1")
def tree_lengths(t):
    out = skeleton.cable_lengths(t.skeletons())
    return out.select("root_id", "n_nodes", F.round(F.coalesce("length", F.lit(0.0)), 4).alias("length"))


@query(with_tables("skeletons") + "SELECT root_id, node_id, x, y, z FROM skeletons QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY (x - 500)^2 + (y - 250)^2 + (z - 6)^2, node_id) = 1")
def tree_root_point(t):
    points = t.table("customer").select(F.col("c_custkey").alias("root_id"), F.lit(500.0).alias("px"), F.lit(250.0).alias("py"), F.lit(6.0).alias("pz"))
    return skeleton.root_points(t.skeletons(), points, "point")


@query(with_tables("skeletons") + """, m AS (SELECT root_id, max(node_id) AS top FROM skeletons GROUP BY 1), a AS (SELECT root_id, top, unnest([top // 1, top // 2, top // 4, top // 8, top // 16, top // 32, top // 64, top // 128, top // 256]) AS node FROM m),
    path AS (SELECT DISTINCT root_id, top, node FROM a WHERE node >= 1), below AS (SELECT root_id, node // 2 AS node, node AS child FROM path WHERE node > 1)
    SELECT s.root_id, s.node_id, CASE WHEN s.node_id = m.top THEN -1 WHEN b.child IS NOT NULL THEN b.child::INT ELSE s.parent_id END AS parent_id FROM skeletons s JOIN m USING (root_id) LEFT JOIN below b ON b.root_id = s.root_id AND b.node = s.node_id""")
def tree_reroot(t):
    nodes = t.skeletons()
    last = nodes.groupBy("root_id").agg(F.max("node_id").alias("node_id"))
    return skeleton.reroot(nodes, last).select("root_id", "node_id", "parent_id")


@query("WITH RECURSIVE " + with_tables("skeletons").removeprefix("WITH ") + """, e AS (SELECT c.root_id, c.node_id, c.parent_id, sqrt(coalesce((c.x - p.x)^2 + (c.y - p.y)^2 + (c.z - p.z)^2, 0)) AS length FROM skeletons c LEFT JOIN skeletons p ON p.root_id = c.root_id AND p.node_id = c.parent_id),
    w AS (SELECT root_id, node_id, 0::DOUBLE AS d FROM e WHERE parent_id = -1 UNION ALL SELECT e.root_id, e.node_id, w.d + e.length FROM w JOIN e ON e.root_id = w.root_id AND e.parent_id = w.node_id)
    SELECT root_id, node_id, 1::BIGINT AS top, round(d, 4) AS distance FROM w""")
def tree_distances(t):
    return paths.distances(t.skeletons()).select("root_id", "node_id", "top", F.round("distance", 4).alias("distance"))


_KEY = "WITH RECURSIVE " + with_tables("skeletons").removeprefix("WITH ") + """, e AS (SELECT c.root_id, c.node_id, c.parent_id, sqrt(coalesce((c.x - p.x)^2 + (c.y - p.y)^2 + (c.z - p.z)^2, 0)) AS length FROM skeletons c LEFT JOIN skeletons p ON p.root_id = c.root_id AND p.node_id = c.parent_id),
    up AS (SELECT root_id, node_id, node_id AS top, 0::DOUBLE AS d FROM e UNION ALL SELECT up.root_id, up.node_id, e.parent_id, up.d + e.length FROM up JOIN e ON e.root_id = up.root_id AND e.node_id = up.top WHERE e.parent_id <> -1),
    gap AS MATERIALIZED (SELECT a.root_id, a.node_id AS a, b.node_id AS b, round(min(a.d + b.d), 6) AS d FROM up a JOIN up b ON a.root_id = b.root_id AND a.top = b.top GROUP BY ALL),
    deg AS (SELECT root_id, node, count(*) AS n FROM (SELECT root_id, node_id AS node FROM e WHERE parent_id <> -1 UNION ALL SELECT root_id, parent_id FROM e WHERE parent_id <> -1) GROUP BY ALL),
    ends AS (SELECT e.root_id, node_id FROM e LEFT JOIN deg ON deg.root_id = e.root_id AND node = node_id WHERE coalesce(n, 0) <= 1),
    first AS (SELECT root_id, node_id AS root FROM e WHERE parent_id = -1),
    start AS (SELECT n.root_id, arg_max(n.node_id, (g.d, -n.node_id)) AS s FROM ends n JOIN first USING (root_id) JOIN gap g ON g.root_id = n.root_id AND g.a = root AND g.b = n.node_id GROUP BY ALL),
    goal AS (SELECT n.root_id, any_value(s) AS s, arg_max(n.node_id, (g.d, -n.node_id)) AS t, max(g.d) AS d FROM ends n JOIN start USING (root_id) JOIN gap g ON g.root_id = n.root_id AND g.a = s AND g.b = n.node_id WHERE n.node_id <> s GROUP BY ALL),
    spine AS (SELECT x.root_id, x.b AS node FROM goal JOIN gap x ON x.root_id = goal.root_id AND x.a = s JOIN gap y ON y.root_id = goal.root_id AND y.a = t AND y.b = x.b WHERE abs(x.d + y.d - goal.d) < 1e-4),
    side AS (SELECT n.root_id, n.node_id, min(g.d) AS side, arg_min(g.b, (g.d, g.b)) AS place FROM ends n JOIN goal USING (root_id) JOIN spine USING (root_id) JOIN gap g ON g.root_id = n.root_id AND g.a = n.node_id AND g.b = spine.node WHERE n.node_id NOT IN (s, t) GROUP BY ALL),
    best AS (SELECT side.root_id, arg_max(place, (side, g.d, -side.node_id)) AS place FROM side JOIN start USING (root_id) JOIN gap g ON g.root_id = side.root_id AND g.a = s AND g.b = side.node_id WHERE side > 0 GROUP BY ALL),
    found AS (SELECT root_id, coalesce(place, s) AS node_id, place IS NOT NULL AS branched FROM start LEFT JOIN best USING (root_id))
    SELECT c_custkey AS root_id, round(x / 16, 6) AS x, round(y / 16, 6) AS y, round(z / 45, 6) AS z, branched, found.root_id IS NULL AS failed FROM customer LEFT JOIN found ON found.root_id = c_custkey LEFT JOIN skeletons k ON k.root_id = c_custkey AND k.node_id = found.node_id"""


def _key_points(t, large):
    out = skeleton.key_points(t.skeletons(), t.table("customer").select(F.col("c_custkey").alias("root_id")), large=large)
    return out.select("root_id", *[r6(F.col(a)).alias(a) for a in "xyz"], "branched", "failed")


@query(_KEY)
def tree_keypoint(t):
    return _key_points(t, skeleton.LARGE)


@query(_KEY)
def tree_keypoint_joins(t):
    """The same as tree_keypoint, every tree by joins, as only very large ones are otherwise."""
    return _key_points(t, 0)


@query("""WITH f AS (SELECT c_nationkey AS fragment, count(*)::INT AS n FROM customer GROUP BY 1), s AS (SELECT fragment, coalesce(sum(n) OVER (ORDER BY fragment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift, n FROM f)
    SELECT fragment, 0 AS face, shift AS v0, shift + 1 AS v1, shift + n - 1 AS v2 FROM s""")
def mesh_concat(t):
    fragments = t.table("customer").groupBy(F.col("c_nationkey").alias("fragment")).agg(F.count(F.lit(1)).cast("int").alias("n_vertices"))
    fragments = fragments.withColumn("faces", F.array(F.array(F.lit(0), F.lit(1), F.col("n_vertices") - 1)))
    return welding.concat_meshes(fragments).select("fragment", "face", *[F.col("v")[i].alias(f"v{i}") for i in range(3)])


@query("SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END AS said FROM customer WHERE abs(c_acctbal) BETWEEN 0.01 AND 1000000")
def number_format(t):
    return t.table("customer").where(F.abs("c_acctbal").between(0.01, 1_000_000)).select("c_custkey", number_text(F.col("c_acctbal")).alias("said"))


@query("""WITH d AS (SELECT DISTINCT (floor(c_acctbal / 100))::BIGINT AS x, c_nationkey::BIGINT AS y FROM customer)
    SELECT x + dx AS x, y + dy AS y, count(*) AS n_faces FROM d, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) v(dx, dy) GROUP BY 1, 2""")
def mesh_weld(t):
    """Squares of a grid as fragments with corners of their own, a little off; welded, each corner is one vertex of all squares around it."""
    squares = t.table("customer").select(F.floor(F.col("c_acctbal") / 100).alias("fx"), F.col("c_nationkey").cast("long").alias("fy")).distinct().withColumn("fragment", F.struct("fx", "fy"))
    corner = F.posexplode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))))).alias("vertex", "c")
    off = (F.pmod(F.xxhash64("fx", "fy"), F.lit(7)) - 3) * 1e-5
    vertices = squares.select("fragment", "fx", "fy", corner).select("fragment", "vertex", (F.col("fx") + F.col("c.dx") + off).alias("x"), (F.col("fy") + F.col("c.dy") + off).alias("y"), F.lit(0.0).alias("z"))
    faces = squares.select("fragment", F.lit(0).alias("face"), F.array(*map(F.lit, range(4))).alias("v"))
    welded, whole = welding.weld(vertices, faces, 1e-3)
    used = whole.select(F.explode("v").alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n_faces"))
    return welded.join(used, F.col("index") == F.col("of")).select(F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"), "n_faces")
