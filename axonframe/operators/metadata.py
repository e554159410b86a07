"""Annotation tables: scans, query strings, unique ids and the common schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.columns import require_columns
from axonframe.functions.shared import fresh
from axonframe.operators.versions import root_at


def query_predicate(query: str, ignore_case: bool = False, fixed: bool = False) -> Column:
    """A condition from "field:pattern" (a leading slash is allowed): the whole field matches the regular expression, or equals the pattern where fixed."""
    field, colon, pattern = query.removeprefix("/").partition(":")
    if not colon or not field:
        raise ValueError(f"a query looks like field:pattern, not {query!r}")
    column = F.col(field).cast("string")
    if fixed:
        return F.lower(column) == pattern.lower() if ignore_case else column == pattern
    return column.rlike(f"{'(?i)' if ignore_case else ''}\\A(?:{pattern})\\z")


def scan(df: DataFrame, keep: dict | None = None, drop: dict | None = None, regex: dict | None = None, select: list[str] | None = None, order: list[str] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows whose columns are among `keep`, not among `drop` (nulls are not) and match `regex` somewhere; then columns; then a page in a total order.

    Without offset and limit all rows come; conditions on stored columns reach the file scan.
    """
    for column, values in (keep or {}).items():
        df = df.where(F.col(column).isin(list(values)))
    for column, values in (drop or {}).items():
        df = df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))
    for column, pattern in (regex or {}).items():
        df = df.where(F.col(column).rlike(pattern))
    if offset or limit is not None:
        if not order:
            raise ValueError("a page needs an order")
        df = df.orderBy(*order).offset(offset)
        df = df if limit is None else df.limit(limit)
    return df.select(*select) if select else df


def good_status(bad=("duplicate", "bad_nucleus")) -> Column:
    """A null status is good."""
    return F.col("status").isNull() | ~F.col("status").isin(list(bad))


def unique_rows(df: DataFrame, key: str = "root_id", order: str = "_id") -> tuple[DataFrame, DataFrame]:
    """The first row of each key (nulls of `order` last, ties by the rows' text), and all rows of keys with several: min_by and a join, so that a hot key's rows never meet in one window."""
    row, of = F.struct(*df.columns), fresh("of", df)
    groups = df.groupBy(F.col(key).alias(of)).agg(F.min_by(row, F.struct(F.col(order).isNull(), order, F.to_json(row))).alias("first"), F.count(F.lit(1)).alias("rows"))
    several = df.join(groups.where("rows > 1").select(of), F.col(key).eqNullSafe(F.col(of)), "left_semi")
    return groups.select("first.*"), several


def metadata(df: DataFrame, ids: DataFrame | list | str | None = None, ignore_case: bool = False, fixed: bool = False, unique: bool = False, history: DataFrame | None = None, at: Column | None = None, exclude_status=("duplicate", "bad_nucleus")) -> tuple[DataFrame, DataFrame | None]:
    """Annotation rows for ids (a query string, a list, or a DataFrame with root_id), and the duplicates that `unique` took out.

    With history and at, ids are those of that moment, through the supervoxel.
    """
    require_columns(df, "root_id")
    if exclude_status and "status" in df.columns:
        df = df.where(good_status(exclude_status))
    if history is not None:
        df = root_at(df, history, at)
    if isinstance(ids, str):
        df = df.where(query_predicate(ids, ignore_case, fixed))
    elif isinstance(ids, DataFrame):
        df = df.join(ids.select(F.col("root_id").alias("__id")).distinct(), F.col("root_id") == F.col("__id"), "left_semi")
    elif ids is not None:
        df = df.where(F.col("root_id").isin([int(i) for i in ids]))
    return unique_rows(df) if unique else (df, None)


def ids_of(df: DataFrame, ids=None, unique: bool = False, **options) -> DataFrame:
    """The root_id column of metadata; duplicates stay unless unique."""
    rows = metadata(df, ids, **options)[0].select("root_id")
    return rows.distinct() if unique else rows


def common_schema(df: DataFrame) -> DataFrame:
    """The columns of cross-dataset queries: id, lineage, and a class hierarchy one level lower; a null instance is filled with type_side (a null type reads NA, a null side nothing).

    All old values are read at once. superclass and subsubclass need not both be there: only those renamed must.
    """
    require_columns(df, "root_id", "hemilineage", "superclass", "class", "subclass", "instance", "type", "side")
    new = {
        "root_id": F.col("root_id").alias("id"),
        "hemilineage": F.col("hemilineage").alias("lineage"),
        "superclass": F.col("superclass").alias("class"),
        "class": F.col("class").alias("subclass"),
        "subclass": F.col("subclass").alias("subsubclass"),
        "instance": F.coalesce("instance", F.concat(F.coalesce("type", F.lit("NA")), F.lit("_"), F.coalesce("side", F.lit("")))).alias("instance"),
    }
    return df.select(*[new.get(c, F.col(c)) for c in df.columns if c != "subsubclass"])


def count_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Rows per combination; null is one value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def add_count(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Each row with its group's size, by an aggregate joined back: the aggregate shrinks before it is shuffled and a hot group's rows can be split."""
    keys, total = {c: fresh(f"of_{i}", df) for i, c in enumerate(columns)}, fresh("total", df)
    counts = count_by(df, *columns, name=total).select(*[F.col(c).alias(n) for c, n in keys.items()], total)
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in keys.items()])
    return df.join(counts, on).select(*[c for c in df.columns if c != name], F.col(total).alias(name))


def wide_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by column, one output column per value, null where there are none."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
