"""Column helpers: required columns, finite checks, plain text of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> None:
    """Raises, naming the columns that are missing, before any plan is built."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def is_finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def is_blank(c: Column) -> Column:
    """Null and the empty string both mean "not there"."""
    return c.isNull() | (c == "")


def number_text(c: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def missing_id(c: Column) -> Column:
    """Null and zero both mean "no segment"."""
    return F.coalesce(c, F.lit(0)) == 0


def map_suffix(df: DataFrame, suffix: str, f) -> DataFrame:
    """Applies f to every column whose name ends with suffix."""
    return df.withColumns({c: f(F.col(c)) for c in df.columns if c.endswith(suffix)})
