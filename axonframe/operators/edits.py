"""The edit-operation log: planning, union with drift, answers in order, frames of a movie."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.functions.coords import VOXEL_NM, raw_to_nm
from axonframe.functions.edits import affiliation_colour, centroid, frame_of
from axonframe.functions.shared import fresh
from axonframe.operators.maintenance import numbered

DERIVED = ("sink_x", "sink_y", "sink_z", "source_x", "source_y", "source_z", "operation_ts")


def to_fetch(wanted: DataFrame, cached: DataFrame | None, missing: DataFrame | None, key: str = "operation_id") -> DataFrame:
    """Wanted ids, each once, that are neither cached nor known to be missing."""
    known = None
    for df in (cached, missing):
        if df is not None:
            ids = df.select(F.col(key).alias("__k"))
            known = ids if known is None else known.union(ids)
    out = wanted.select(key).distinct()
    return out if known is None else out.join(known, F.col(key) == F.col("__k"), "left_anti")


def new_missing(asked: DataFrame, fresh: DataFrame, key: str = "operation_id") -> DataFrame:
    """Asked ids that did not come."""
    return asked.select(key).distinct().join(fresh.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def union_fill(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; columns of the first, then new ones of the second, null where a side lacks them."""
    return first.unionByName(second, allowMissingColumns=True)


def stored_columns(df: DataFrame) -> DataFrame:
    """Without columns that are derived on reading."""
    return df.drop(*DERIVED)


def seed_cache(cached: DataFrame, more: DataFrame, key: str = "operation_id") -> DataFrame:
    """cached with those rows of more whose ids it lacks, existing rows first."""
    new = stored_columns(more).join(cached.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    return union_fill(cached, new)


def in_requested_order(wanted: DataFrame, log: DataFrame, key: str = "operation_id", ordinal: str = "ordinal", order: str = "timestamp") -> DataFrame:
    """wanted(ordinal, key) joined to the log's first row of the key, by `order` if the log has it and then by the rows' text; ids asked twice come twice, those not in the log not at all."""
    rest = [c for c in log.columns if c != key]
    row = F.struct(*rest)
    first = log.groupBy(F.col(key).alias("__k")).agg(F.min_by(row, F.struct(*([order] if order in rest else []), F.to_json(row))).alias("__r"))
    # Null-safe, so that the log's rows are dealt anew: a join on the aggregate's own key could not be split where an id is asked very often.
    return wanted.select(ordinal, key).where(F.col(key).isNotNull()).join(first, F.col(key).eqNullSafe(F.col("__k"))).select(ordinal, key, *[F.col("__r")[c].alias(c) for c in rest])


def details_from_json(df: DataFrame, column: str = "json", fields: str = "timestamp string, user string, status string, sink_coords string, source_coords string") -> DataFrame:
    """Rows operation_id, fields.. from JSON objects keyed by operation id. Ids stay exact; keys that are no integers, and lists, raise on reading; an empty object gives no rows."""
    schema = T.MapType(T.StringType(), T._parse_datatype_string(fields))
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    bad = F.trim(column).startswith("[") & ~F.trim(column).rlike(r"^\[\s*\]$")
    rows = df.select(F.when(bad, F.raise_error(F.lit("operation details did not include valid operation IDs"))).otherwise(parsed).alias("__m")).select(F.explode("__m").alias("__k", "__v"))
    key = F.col("__k").try_cast("int")
    key = F.when(key.isNull(), F.raise_error(F.lit("operation details did not include valid operation IDs"))).otherwise(key).cast("int")
    names = [f.name for f in schema.valueType.fields]
    value = lambda c: F.to_timestamp(F.col("__v")[c]) if c == "timestamp" else F.col("__v")[c]
    return rows.select(key.alias("operation_id"), *[value(c).alias(c) for c in names])


def fetch_operations(ids: DataFrame, fetch, chunksize: int = 50) -> DataFrame:
    """Rows of details_from_json for ids(operation_id) from a remote service: each partition asks fetch(list of ids) for at most chunksize operations at a time, and gets a JSON object keyed by id."""

    def ask(frames):
        for pdf in frames:
            wanted = pdf["operation_id"].astype(int).tolist()
            yield pd.DataFrame({"json": [fetch(wanted[i : i + chunksize]) for i in range(0, len(wanted), chunksize)]})

    return details_from_json(ids.select("operation_id").mapInPandas(ask, "json string"))


def add_centroids(df: DataFrame) -> DataFrame:
    """Adds sink_x .. source_z; unchanged where a coordinate column is absent."""
    if not {"sink_coords", "source_coords"} <= set(df.columns):
        return df
    for end in ("sink", "source"):
        c = centroid(F.col(f"{end}_coords"))
        df = df.withColumns({f"{end}_{a}": c[a] for a in "xyz"})
    return df


def last_operation(log: DataFrame, start: int | None = None, stop: int | None = None, key: str = "operation_id") -> DataFrame:
    """One row: the greatest id in the log, between bounds if given. Gaps do no harm."""
    rows = log if start is None else log.where(F.col(key) >= start)
    rows = rows if stop is None else rows.where(F.col(key) < stop)
    return rows.agg(F.max(key).alias("last_operation"))


def exists(log: DataFrame, ids: DataFrame, key: str = "operation_id") -> DataFrame:
    """ids with found."""
    have = log.select(F.col(key).alias("__k")).distinct()
    return ids.join(have, F.col(key) == F.col("__k"), "left").select(*ids.columns, F.col("__k").isNotNull().alias("found"))


def all_operations(log: DataFrame, last: int | None = None, centroids: bool = False) -> DataFrame:
    """The log's rows for ids 1 to last, or all from 1. The bounds reach the scan; nothing is shuffled."""
    rows = log.where(F.col("operation_id") >= 1)
    rows = rows if last is None else rows.where(F.col("operation_id") <= last)
    return add_centroids(rows) if centroids else rows


def with_users(log: DataFrame, users: DataFrame) -> DataFrame:
    """Left join with users(user_id, user_affiliation)."""
    return log.join(users, F.col("user") == F.col("user_id"), "left")


def movie_points(log: DataFrame, fps: int = 10, duration: float = 30, voxel=VOXEL_NM, prefix: str = "sink_") -> DataFrame:
    """Each edit with colour, frame, and position in nm; frames are equal-width time bins of the whole log, whose bounds are one row."""
    frames = int(fps * duration)
    bounds = log.agg(F.min("timestamp").alias("__a"), F.max("timestamp").alias("__b"))
    rows = log.join(F.broadcast(bounds))
    rows = rows.withColumn("frame", frame_of(F.col("timestamp"), F.col("__a"), F.col("__b"), frames)).withColumn("colour", affiliation_colour(F.col("user_affiliation"))).drop("__a", "__b")
    return raw_to_nm(rows, voxel, prefix) if prefix + "x" in log.columns else rows


def movie_frames(points: DataFrame, frames: int) -> DataFrame:
    """Per frame that has edits: n, shown (edits up to it) and progress. The running sum is over at most `frames` rows."""
    n = points.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    return n.select("frame", "n", running.alias("shown"), (F.col("frame") / frames).alias("progress"))


def batches(df: DataFrame, order: list[str], size: int, out: str = "batch") -> DataFrame:
    """df with the row's place in order (place, from 1) and the number (from 1) of its batch of at most size consecutive rows, as a service takes them. Places are sums over range partitions."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    by, place = fresh("by", df), fresh("place", df)
    numbered_rows = numbered(df.withColumn(by, F.struct(*order)), by, place)
    return numbered_rows.select(*df.columns, F.col(place).alias("place"), (F.floor((F.col(place) - 1) / size) + 1).cast("long").alias(out))


def bounding_box(df: DataFrame, *columns: str) -> DataFrame:
    """Least and greatest value of each column, nulls apart."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
