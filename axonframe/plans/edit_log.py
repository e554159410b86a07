"""The edit log of the dataset that is chosen (registry.choose, registry.using)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axonframe.operators import edits
from axonframe.plans import registry
from axonframe.sources.tables import OperationCache


def _cache(spark: SparkSession, folder: str) -> OperationCache:
    return OperationCache(spark, folder, registry.current().datastack)


def operation_details(spark: SparkSession, wanted: DataFrame, fetch, folder: str, centroids: bool = False) -> DataFrame:
    """Details of wanted(operation_id[, ordinal]) from the current dataset's cache in the folder, fetched first where they are neither there nor known to be missing."""
    rows = _cache(spark, folder).details(wanted, fetch)
    return edits.add_centroids(rows) if centroids else rows


def last_edit(spark: SparkSession, folder: str, start: int | None = None, stop: int | None = None) -> int | None:
    """The greatest id in the current dataset's cache, between bounds if given; None for an empty one."""
    log = _cache(spark, folder).read()
    return None if log is None else edits.last_operation(log, start, stop).first()[0]


def all_operations(spark: SparkSession, fetch, folder: str, last: int | None = None, centroids: bool = False) -> DataFrame:
    """Operations 1 to last (the greatest known id where it is None) of the current dataset; what the cache lacks is fetched."""
    last = last_edit(spark, folder) if last is None else last
    if last is None:
        raise ValueError("the cache is empty: say which operation is the last")
    operation_details(spark, spark.range(1, last + 1).selectExpr("cast(id AS int) AS operation_id"), fetch, folder)
    log = _cache(spark, folder).read()
    if log is None:
        raise ValueError("the service has none of the operations")
    return edits.all_operations(log, last, centroids)
