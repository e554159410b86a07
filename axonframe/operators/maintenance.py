"""Keeping the annotation table up to date: refreshed ids, duplicate flags, changes, serials, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.columns import missing_id, require_columns
from axonframe.functions.shared import checkpointed, fresh
from axonframe.operators.versions import root_at


def sequential_update(df: DataFrame, history: DataFrame, at: Column, supervoxels: DataFrame | None = None) -> DataFrame:
    """df with root_id refreshed from its supervoxel; a missing supervoxel is filled first from supervoxels(_id, found) of its point. Nothing else changes."""
    require_columns(df, "supervoxel_id", "root_id")
    if supervoxels is not None:
        found = supervoxels.select(F.col("_id").alias("__id"), F.col("found").alias("__found"))
        joined = df.join(found, F.col("_id") == F.col("__id"), "left")
        filled = F.when(missing_id(F.col("supervoxel_id")), F.coalesce("__found", "supervoxel_id")).otherwise(F.col("supervoxel_id"))
        df = joined.withColumn("supervoxel_id", filled).select(*df.columns)
    return root_at(df, history, at)


def flag_duplicates(df: DataFrame, key: str = "root_id", bad: str = "duplicate", out: str = "root_duplicated") -> DataFrame:
    """Adds a flag: the row's status is good (null is) and its root has several good rows. Counted by an aggregate that is joined back."""
    good = F.col("status").isNull() | (F.col("status") != bad)
    of, many = fresh("of", df), fresh("many", df)
    counts = df.where(good).groupBy(F.col(key).alias(of)).agg(F.count(F.lit(1)).alias(many)).where(F.col(many) > 1)
    joined = df.join(counts, F.col(key).eqNullSafe(F.col(of)), "left")
    return joined.select(*[c for c in df.columns if c != out], (good & F.col(many).isNotNull()).alias(out))


def cell_changed(old: Column, new: Column) -> Column:
    """Both there and different, or new where there was none. A value that became null is no change."""
    return F.coalesce(old != new, F.lit(False)) | (old.isNull() & new.isNotNull())


def changed_rows(old: DataFrame, new: DataFrame, columns: list[str], key: str = "_id") -> DataFrame:
    """Rows of new that differ from old in one of the columns."""
    before = old.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    changed = reduce(lambda a, b: a | b, [cell_changed(F.col(f"__{c}"), F.col(c)) for c in columns])
    return new.join(before, F.col(key) == F.col("__k")).where(changed).select(*new.columns)


def modal_width(df: DataFrame, column: str = "serial_id") -> DataFrame:
    """One row: greatest serial as a number, and the commonest width of its text, the least of equals."""
    widths = df.where(F.col(column).isNotNull()).groupBy(F.length(column).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(column).try_cast("long")).alias("top"))
    return widths.agg(F.coalesce(F.max("top"), F.lit(0)).alias("top"), F.coalesce(F.min_by("w", F.struct(-F.col("n"), "w")), F.lit(1)).alias("width"))


def numbered(df: DataFrame, order: str, out: str = "__rank") -> DataFrame:
    """Rows numbered from 1 in order, without one task for all: range partitions are counted, and each adds the rows before it. The ranges are written down first: made again, they could fall elsewhere."""
    ranged = checkpointed(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.col("__m") - F.shiftleft(part, 33) + 1
    return ranged.withColumn("__q", part).join(before, F.col("__q") == F.col("__p")).withColumn(out, F.col("__before") + within).drop("__m", "__p", "__q", "__before")


def assign_serials(df: DataFrame, order: str = "_id", column: str = "serial_id") -> DataFrame:
    """Rows without serial get the next ones in order, zero-padded to the commonest width; longer numbers keep all digits."""
    need = df.where(F.col(column).isNull())
    ranked = numbered(need, order)
    digits = (F.col("top") + F.col("__rank")).cast("string")
    serial = F.concat(F.repeat(F.lit("0"), F.greatest(F.col("width") - F.length(digits), F.lit(0))), digits)
    filled = ranked.join(F.broadcast(modal_width(df, column))).withColumn(column, serial)
    return df.where(F.col(column).isNotNull()).unionByName(filled.select(*df.columns))


def update_table(df: DataFrame, history: DataFrame, at: Column, update_duplicates: bool = True, serials: bool = False, supervoxels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after the update, rows that changed). Without update_duplicates rows of status duplicate are left alone and only ids and points are compared."""
    rows = df if update_duplicates else df.where(F.col("status").isNull() | (F.col("status") != "duplicate"))
    renewed = sequential_update(rows, history, at, supervoxels)
    columns = ["root_id", "supervoxel_id"] + [c for c in ("point_xyz",) if c in df.columns]
    if update_duplicates:
        renewed = flag_duplicates(renewed)
        columns = columns + ["root_duplicated"] if "root_duplicated" in df.columns else columns
    changed = changed_rows(rows, renewed, columns)
    after = upsert(df, changed.select("_id", *[c for c in columns if c in df.columns]))
    return (assign_serials(after) if serials else after), changed


def upsert(table: DataFrame, rows: DataFrame, key: str = "_id", append: bool = False) -> DataFrame:
    """table with the columns of rows replaced where the key matches; rows with new keys are added where append. Keys of rows have to be unique."""
    require_columns(rows, key)
    new = [c for c in rows.columns if c != key]
    renewed = rows.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in new])
    joined = table.join(renewed, F.col(key) == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    out = joined.select(*[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])
    if append:
        absent = rows.join(table.select(F.col(key).alias("__t")), F.col(key) == F.col("__t"), "left_anti")
        out = out.unionByName(absent, allowMissingColumns=True)
    return out


def check_unique(df: DataFrame, key: str = "_id") -> None:
    """Raises where a key comes twice; one row is read."""
    if not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"duplicate rows by {key}")


def add_neurons(table: DataFrame, ids: DataFrame, points: DataFrame | None = None, strict: bool = True, **constants) -> dict[str, DataFrame]:
    """For ids(root_id): `up`, the table's rows (_id, root_id, constants), and `new`, ids it lacks (root_id, constants, point_xyz). Ids count once; zero is none; new ones are always looked for.

    strict raises where a row to update comes twice, or where the table has more rows for these ids than there are ids.
    """
    wanted = ids.select(F.col("root_id").cast("long").alias("root_id")).where(~missing_id(F.col("root_id"))).distinct()
    extra = [F.lit(v).alias(k) for k, v in constants.items()]
    have = table.select("_id", F.col("root_id").alias("__t"))
    up = wanted.join(have, F.col("root_id") == F.col("__t")).select("_id", "root_id", *extra)
    if strict:
        check_unique(up)
        if not up.groupBy("root_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise ValueError("more rows to update than ids")
    new = wanted.join(have.select("__t"), F.col("root_id") == F.col("__t"), "left_anti")
    if points is not None:
        new = new.join(points.select(F.col("root_id").alias("__p"), "point_xyz"), F.col("root_id") == F.col("__p"), "left").drop("__p")
    return {"up": up, "new": new.select("root_id", *extra, *(["point_xyz"] if points is not None else []))}
