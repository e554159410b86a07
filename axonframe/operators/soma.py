"""Where the soma of a neuron is, and on which side: annotations first, then nuclei, then scored level-2 chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import is_blank, require_columns
from axonframe.functions.coords import VOXEL_NM, format_xyz, parse_xyz
from axonframe.functions.shared import stored
from axonframe.functions.scoring import SomaModel, chunk_features, distance_penalty, mahalanobis
from axonframe.operators.geometry import Mesh, mesh_distance, side_distance, side_of
from axonframe.operators.lookup import Space
from axonframe.operators.nuclei import dedup_nuclei

#: Terms of the score that each method uses: shape, distance from the neuropil.
METHODS = {"l2": (True, False), "l2+mesh": (True, True), "mesh": (False, True)}
RESULT = "root_id long, position string, source string, n_nuclei int, nucleus_id int, soma_score double, dist_npil_nm double, l2_id long"


def score_chunks(chunks: DataFrame, model: SomaModel, mesh: Mesh | None = None, method: str = "l2") -> DataFrame:
    """chunks with dist_npil_nm and soma_score (lower: more like a soma). Chunks without a positive first principal value are left out.

    score = squared Mahalanobis distance of the shape + weight * penalty of the distance; a null distance takes the
    floor density, a null shape makes a null score.
    """
    shape, use_mesh = METHODS[method]
    if use_mesh and mesh is None:
        raise ValueError(f"method {method} needs a mesh")
    rows = chunks.where("pca_val_0 > 0")
    rows = rows.withColumn("dist_npil_nm", F.lit(None).cast("double")) if mesh is None else mesh_distance(rows, mesh, "rep_coord_nm_")
    rows = rows.withColumns(chunk_features())
    score = (mahalanobis(model) if shape else F.lit(0.0)) + (model.weight * distance_penalty(model, F.col("dist_npil_nm") / 1000) if use_mesh else F.lit(0.0))
    return rows.withColumn("soma_score", score)


def best_chunks(membership: DataFrame, attributes: DataFrame, model: SomaModel, mesh: Mesh | None = None, method: str = "l2") -> DataFrame:
    """Each root's chunk with the least score (null scores last, then the least l2_id), as rows of RESULT. Attributes are scored once per chunk, before they meet their roots."""
    scored = score_chunks(attributes, model, mesh, method).select(F.col("l2_id").alias("__l2"), "rep_coord_nm_x", "rep_coord_nm_y", "rep_coord_nm_z", "soma_score", "dist_npil_nm")
    rows = membership.select("root_id", "l2_id").distinct().join(scored, F.col("l2_id") == F.col("__l2"))
    order = F.struct(F.col("soma_score").isNull().alias("n"), F.col("soma_score").alias("s"), F.col("l2_id").alias("i"))
    top = rows.groupBy("root_id").agg(F.min_by(F.struct("rep_coord_nm_x", "rep_coord_nm_y", "rep_coord_nm_z", "soma_score", "dist_npil_nm", "l2_id"), order).alias("b"))
    b = lambda c: F.col("b")[c]
    place = format_xyz(b("rep_coord_nm_x"), b("rep_coord_nm_y"), b("rep_coord_nm_z"))
    return top.select("root_id", place.alias("position"), F.lit(method).alias("source"), F.lit(None).cast("int").alias("n_nuclei"), F.lit(None).cast("int").alias("nucleus_id"), b("soma_score").alias("soma_score"), b("dist_npil_nm").alias("dist_npil_nm"), b("l2_id").alias("l2_id"))


def annotated_somata(annotations: DataFrame, voxel=VOXEL_NM, source: str = "annotation") -> DataFrame:
    """Rows of RESULT from soma_xyz ("x,y,z" voxels), each root's first row by _id (ties by text); nm positions."""
    require_columns(annotations, "root_id", "soma_xyz")
    nucleus = F.col("nucleus_id").cast("int") if "nucleus_id" in annotations.columns else F.lit(None).cast("int")
    by = "_id" if "_id" in annotations.columns else "soma_xyz"
    order = F.struct(F.col(by).isNull().alias("a"), F.col(by).alias("b"), F.col("soma_xyz").alias("c"), nucleus.alias("d"))
    first = annotations.groupBy("root_id").agg(F.min_by(F.struct(F.col("soma_xyz").alias("s"), nucleus.alias("n")), order).alias("f"))
    rows = first.where(~is_blank(F.col("f.s"))).select("root_id", parse_xyz(F.col("f.s")).alias("p"), F.col("f.n").alias("nucleus_id")).where("p IS NOT NULL")
    place = format_xyz(*[F.col(f"p.{a}") * float(v) for a, v in zip("xyz", voxel)])
    return rows.select("root_id", place.alias("position"), F.lit(source).alias("source"), F.lit(None).cast("int").alias("n_nuclei"), "nucleus_id", *_no_score())


def _no_score() -> list[Column]:
    return [F.lit(None).cast(t).alias(c) for c, t in (("soma_score", "double"), ("dist_npil_nm", "double"), ("l2_id", "long"))]


def with_known_scores(rows: DataFrame, mesh: Mesh, space: Space | None = None, attributes: DataFrame | None = None, model: SomaModel | None = None, voxel=VOXEL_NM) -> DataFrame:
    """Rows of RESULT with the distance of their positions from the mesh, and with a space the level-2 chunk that each position lies in and, with attributes and model, that chunk's score.

    A chunk without attributes, or that score_chunks leaves out, gives no score; a position in no chunk keeps what it had.
    Only chunks that a position lies in are scored, each once.
    """
    p = parse_xyz(F.col("position"))
    rows = rows.select("*", *[p[a].alias(a) for a in "xyz"])
    rows = mesh_distance(rows.drop("dist_npil_nm"), mesh)
    if space is not None:
        rows = space.level2(rows.withColumnRenamed("l2_id", "l2_before"), voxel)
        if attributes is not None and model is not None:
            rows = stored(rows, "known")  # read twice below
            asked = rows.select(F.col("l2_id").alias("asked")).where("asked IS NOT NULL").distinct()
            scored = score_chunks(attributes.join(asked, F.col("l2_id") == F.col("asked"), "left_semi"), model, mesh, "l2+mesh").groupBy(F.col("l2_id").alias("of")).agg(F.min("soma_score").alias("found"))
            rows = rows.join(scored, F.col("l2_id").eqNullSafe(F.col("of")), "left").withColumn("soma_score", F.coalesce("found", "soma_score"))
        rows = rows.withColumn("l2_id", F.coalesce("l2_id", "l2_before"))
    return rows.select("root_id", "position", "source", "n_nuclei", "nucleus_id", "soma_score", "dist_npil_nm", "l2_id")


def soma_positions(ids: DataFrame, method: str = "auto", annotations: DataFrame | None = None, nuclei: DataFrame | None = None, membership: DataFrame | None = None, attributes: DataFrame | None = None, model: SomaModel | None = None, mesh: Mesh | None = None, keep: str = "largest", units: str = "nm", voxel=VOXEL_NM, source: str = "annotation", space: Space | None = None) -> DataFrame:
    """ordinal and RESULT for ids(ordinal, root_id), in input order by ordinal: the first source that has the root.

    Sources of auto: annotations, nuclei, and with a mesh the scored chunks; each is cut to the wanted roots before it is
    aggregated, parsed or measured, and gives those that the ones before it lack. With a mesh, annotated and nuclear
    positions get their distance from it and, with a space, their level-2 chunk and its score. Roots in no source give a row of nulls; an id that comes twice gives its rows twice.
    """
    require_columns(ids, "ordinal", "root_id")
    if method in ("l2+mesh", "mesh") and mesh is None:
        raise ValueError(f"method {method} needs a mesh")
    wanted = ids.select("root_id").where("root_id IS NOT NULL").distinct()
    found = None

    def asked(rows: DataFrame, key: str = "root_id") -> DataFrame:
        return rows.join(wanted.select(F.col("root_id").alias("__w")), F.col(key) == F.col("__w"), "left_semi")

    def known(rows: DataFrame) -> DataFrame:
        return rows if mesh is None else with_known_scores(rows, mesh, space, attributes, model, voxel)

    def add(rows: DataFrame) -> DataFrame:
        if found is None:
            return rows
        return found.unionByName(rows.join(found.select(F.col("root_id").alias("__f")), F.col("root_id") == F.col("__f"), "left_anti"))

    if method in ("auto", source, "annotation") and annotations is not None:
        rows = annotated_somata(asked(annotations), voxel, source)
        found = add(known(rows))
    if method in ("auto", "nucleus") and nuclei is not None:
        rows = dedup_nuclei(asked(nuclei, "pt_root_id"), keep).select("root_id", "position", "source", "n_nuclei", F.col("nucleus_id").cast("int").alias("nucleus_id"), *_no_score())
        found = add(known(rows))
    if membership is not None and (method in METHODS or method == "auto" and mesh is not None):
        found = add(best_chunks(asked(membership), attributes, model, mesh, method if method in METHODS else "l2+mesh"))
    if found is None:
        raise ValueError(f"method {method} has no source")
    if units == "raw":
        p = parse_xyz(F.col("position"))
        found = found.withColumn("position", format_xyz(*[p[a] / float(v) for a, v in zip("xyz", voxel)]))
    renamed = found.withColumnRenamed("root_id", "__root")
    return ids.join(renamed, F.col("root_id") == F.col("__root"), "left").drop("__root")


def clean_side(side: Column) -> Column:
    """L, R, M or U in upper case; anything else is null."""
    upper = F.upper(side)
    return F.when(upper.isin("L", "R", "M", "U"), upper)


def soma_sides(ids: DataFrame, annotations: DataFrame, positions: DataFrame | None = None, mirrored_x: str | None = None, method: str = "auto", threshold: float = 0) -> DataFrame:
    """ids with side: the annotated one (manual), that of the mirrored soma position (position), or the first of these there is (auto)."""
    manual = annotations.groupBy(F.col("root_id").alias("__a")).agg(F.min_by(clean_side(F.col("side")), F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("side").alias("c"))).alias("__manual")) if "side" in annotations.columns else None
    if manual is None and method == "manual":
        raise ValueError("missing required columns: side")
    df = ids if manual is None or method == "position" else ids.join(manual, F.col("root_id") == F.col("__a"), "left").drop("__a")
    parts = [F.col("__manual")] if "__manual" in df.columns else []
    if method != "manual" and positions is not None:
        side = side_of(side_distance(F.col("x"), F.col(mirrored_x or "m_x")), threshold)
        df = df.join(positions.select(F.col("root_id").alias("__p"), side.alias("__side")), F.col("root_id") == F.col("__p"), "left").drop("__p")
        parts.append(F.col("__side"))
    return df.withColumn("side", F.coalesce(*parts)).drop("__manual", "__side")
