"""Versions, timestamps and time travel of ids."""

from __future__ import annotations

import warnings
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import missing_id, require_columns
from axonframe.functions.shared import dropped, fresh, stored

_default: list = ["latest"]


@dataclass(frozen=True)
class VersionInfo:
    """A version, or a timestamp (a Column or text), or neither: the live state."""

    version: object = None
    timestamp: object = None


def set_version(which="now") -> object:
    """Sets the session's default selector ("now", "latest", a version or a date); returns the former one."""
    before, _default[0] = _default[0], which
    return before


def get_version(which=None, version=None, timestamp=None) -> VersionInfo:
    """An explicit version wins (a timestamp beside it is dropped with a warning), then an explicit timestamp, then `which` or the session's default: "latest" and numbers are versions, all else are timestamps."""
    if version is not None:
        if timestamp is not None:
            warnings.warn("both version and timestamp given; the timestamp is not used", stacklevel=2)
        return VersionInfo(version=version)
    if timestamp is not None:
        return VersionInfo(timestamp=timestamp)
    which = _default[0] if which is None else which
    number = isinstance(which, (int, float)) or (isinstance(which, str) and which.isdigit())
    if which == "latest" or number:
        return VersionInfo(version="latest" if which == "latest" else int(which))
    return VersionInfo(timestamp=which)


@contextmanager
def default_version(which):
    """The session's default inside a with block."""
    before = set_version(which)
    try:
        yield
    finally:
        set_version(before)


def moment(selector: VersionInfo, versions: DataFrame | None = None) -> Column:
    """The timestamp that a selector means; versions(version, timestamp) is a list of releases, of which one row is read."""
    if selector.timestamp is not None:
        return F.current_timestamp() if selector.timestamp == "now" else F.lit(selector.timestamp).cast("timestamp")
    if versions is None:
        raise ValueError("a version needs the table of versions")
    require_columns(versions, "version", "timestamp")
    rows = versions if selector.version == "latest" else versions.where(F.col("version") == selector.version)
    found = rows.orderBy(F.desc("version")).select("timestamp").first()
    if found is None:
        raise ValueError(f"no version {selector.version}")
    return F.lit(found[0]).cast("timestamp")


def root_at(df: DataFrame, history: DataFrame, at: Column, supervoxel: str = "supervoxel_id", root: str | None = "root_id", out: str = "root_id") -> DataFrame:
    """df with the root that held each row's supervoxel at a moment: an equi join on the supervoxel with the validity interval [valid_from, valid_to) as residue.

    Rows without supervoxel, and supervoxels without an interval then, keep `root` (null where root is None).
    """
    require_columns(df, supervoxel)
    require_columns(history, "supervoxel_id", "root_id", "valid_from", "valid_to")
    then = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    held = history.where(then).select(F.col("supervoxel_id").alias("__sv"), F.col("root_id").alias("__root"))
    joined = df.join(held, (F.col(supervoxel) == F.col("__sv")) & ~missing_id(F.col(supervoxel)), "left")
    fallback = F.col(root) if root else F.lit(None)
    order = [c for c in df.columns if c != out]
    now = F.coalesce(F.col("__root"), fallback).alias(out)
    return joined.select(*[now if c == out else F.col(c) for c in df.columns] if out in df.columns else [*map(F.col, order), now])


def latest_ids(ids: DataFrame, lineage: DataFrame, at: Column) -> DataFrame:
    """ids(root_id) with latest_id: the id itself while valid at the moment, else the successor valid then; lineage(root_id, new_id, valid_from, valid_to) has a row per id, its successors and their validity."""
    then = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    heir = lineage.where(then).groupBy(F.col("root_id").alias("__old")).agg(F.min(F.when(F.col("new_id") == F.col("root_id"), F.col("new_id"))).alias("__same"), F.min("new_id").alias("__heir"))
    return ids.join(heir, F.col("root_id") == F.col("__old"), "left").select(*ids.columns, F.coalesce("__same", "__heir", "root_id").alias("latest_id"))


#: Rounds of doubling, enough for chains of 2 ** 40 edits; a longer one is a circle.
MOST_ROUNDS = 40


def current_ids(ids: DataFrame, edits: DataFrame, at: Column | None = None) -> DataFrame:
    """ids(root_id, ..) with latest_id: what an id has become by the edits up to a moment (all of them where it is None), over any number of merges and splits.

    edits(old_id, new_id, timestamp[, share]): an edit's new ids for each id that it replaced. Of several new ids the one
    with the greatest share of the old one counts (nulls last), then the least. An id that no edit replaced stays as it
    is; a null stays null, and so do all other columns. Rows of edits with a null id, or with equal ids, are left out;
    ids that replace each other in a circle are an error.

    Each id points to its successor, one row for each id that was replaced, and each round lets the pointers skip twice
    as far, so that 20 edits in a row take five joins. A pointer that has arrived takes no further part, and a successor
    of very many ids is one row on the side that is looked up.
    """
    require_columns(edits, "old_id", "new_id", *(("timestamp",) if at is not None else ()))
    rows = edits.where("old_id <> new_id")
    rows = rows if at is None else rows.where(F.col("timestamp") <= at)
    share = F.col("share").cast("double") if "share" in edits.columns else F.lit(None).cast("double")
    order = F.struct(share.isNotNull(), F.coalesce(share, F.lit(0.0)), -F.col("new_id"))
    heirs = stored(rows.groupBy(F.col("old_id").alias("from_id")).agg(F.max_by("new_id", order).alias("to_id")).withColumn("moving", F.lit(True)), "heirs")
    for _ in range(MOST_ROUNDS):
        further = heirs.select(F.col("from_id").alias("mid"), F.col("to_id").alias("next_id"), F.col("moving").alias("still"))
        moved = heirs.where("moving").join(further, F.col("to_id") == F.col("mid"), "left").select("from_id", F.coalesce("next_id", "to_id").alias("to_id"), F.coalesce("still", F.lit(False)).alias("moving"))
        last, heirs = heirs, stored(heirs.where("NOT moving").union(moved), "heirs")
        dropped(last)
        if heirs.where("moving").isEmpty():
            break
    else:
        raise ValueError("ids replace each other in a circle")
    of, to = fresh("of", ids), fresh("to", ids)
    joined = ids.join(heirs.select(F.col("from_id").alias(of), F.col("to_id").alias(to)), F.col("root_id") == F.col(of), "left")
    return joined.select(*(F.col(c) for c in ids.columns if c != "latest_id"), F.coalesce(to, "root_id").alias("latest_id"))


def snapshot(df: DataFrame, keys: list[str], at: Column, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Each key's last row at a moment. max_by combines before the shuffle; ties go to the greatest `tie`."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(ts, tie) if tie else F.col(ts)
    last = df.where(F.col(ts) <= at).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return last.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def normalise_ids(df: DataFrame, column: str = "root_id", unique: bool = False, drop_zero: bool = False) -> DataFrame:
    """Ids as 64-bit integers, whatever text or number they came as; text that is none becomes null."""
    out = df.withColumn(column, F.col(column).cast("string").try_cast("long"))
    if drop_zero:
        out = out.where(~missing_id(F.col(column)))
    return out.select(column).distinct() if unique else out
