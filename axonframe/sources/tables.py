"""Reading and writing of tables: files, caches, sheets, upserts that only write what changed."""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.shared import checkpointed
from axonframe.operators.edits import in_requested_order, new_missing, stored_columns, to_fetch

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A file or folder by its ending (parquet where there is none). CSV has a header; with a schema nothing is inferred."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1], "parquet")
    reader = spark.read.options(**({"header": True, "inferSchema": schema is None} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def read_by_ids(table: DataFrame, ids: DataFrame, key: str = "root_id", columns: list[str] | None = None) -> DataFrame:
    """Rows of a table (nuclei, chunk membership, chunk attributes, skeletons) whose key is among the ids; only the asked columns are read."""
    wanted = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    rows = table.join(wanted, F.col(key) == F.col("__id"), "left_semi")
    return rows.select(*columns) if columns else rows


def list_tables(spark: SparkSession) -> DataFrame:
    """(name, kind) of the catalogue's tables and views."""
    return spark.createDataFrame([(t.name, t.tableType) for t in spark.catalog.listTables()], "name string, kind string")


def sql_over(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """A literal SQL query over named DataFrames."""
    return spark.sql(query, **tables) if "{" in query else _sql_views(spark, query, tables)


def _sql_views(spark: SparkSession, query: str, tables: dict) -> DataFrame:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's own file systems, so that any store it reads will do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def age_seconds(spark: SparkSession, path: str) -> float:
    """How long ago the path was last written to, by the clock of the store that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return time.time() - store.getFileStatus(target).getModificationTime() / 1000


def cached(spark: SparkSession, path: str, build, refresh: bool = False, expires: float | None = None) -> DataFrame:
    """The table at path, built and written first where it is not there, is older than `expires` seconds, or refresh is asked for."""
    if refresh or not path_exists(spark, path) or expires is not None and age_seconds(spark, path) > expires:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class OperationCache:
    """Fetched operations and ids known to be missing, as two Parquet folders that only grow; one cache per dataset."""

    def __init__(self, spark: SparkSession, folder: str, dataset: str):
        self.spark, self.log, self.gaps = spark, f"{folder}/{dataset}_operations", f"{folder}/{dataset}_missing"

    def read(self) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(self.log) if path_exists(self.spark, self.log) else None

    def read_missing(self) -> DataFrame:
        if path_exists(self.spark, self.gaps):
            return self.spark.read.parquet(self.gaps).distinct()
        return self.spark.createDataFrame([], "operation_id int")

    def append(self, fresh: DataFrame) -> None:
        """Derived columns are not stored; an empty batch writes nothing."""
        if not fresh.isEmpty():
            stored_columns(fresh).write.mode("append").parquet(self.log)

    def append_missing(self, ids: DataFrame) -> None:
        if not ids.isEmpty():
            ids.select("operation_id").write.mode("append").parquet(self.gaps)

    def populate(self, more: DataFrame) -> None:
        """Adds those rows whose ids the cache lacks."""
        have = self.read()
        if have is None:
            return self.append(more)
        self.append(stored_columns(more).join(have.select(F.col("operation_id").alias("__k")), F.col("operation_id") == F.col("__k"), "left_anti"))

    def details(self, wanted: DataFrame, fetch) -> DataFrame:
        """wanted(operation_id, and ordinal for an order): plans what is neither cached nor known to be missing, lets fetch(DataFrame of ids) bring it once, keeps it, and answers from the cache. Ids asked twice come twice; those that are nowhere do not come."""
        plan = checkpointed(to_fetch(wanted, self.read(), self.read_missing()))
        if not plan.isEmpty():
            fresh = checkpointed(fetch(plan))
            self.append_missing(new_missing(plan, fresh))
            self.append(fresh)
        log = self.read()
        if log is None:
            return wanted.limit(0)
        if "ordinal" in wanted.columns:
            return in_requested_order(wanted, log)
        return in_requested_order(wanted.select("operation_id", F.monotonically_increasing_id().alias("ordinal")), log).drop("ordinal")


def table_digest(df: DataFrame) -> str:
    """A digest of rows and columns that their order and partitions do not change."""
    columns = sorted(df.columns)
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return hashlib.md5(json.dumps([columns, [str(v) for v in row]]).encode()).hexdigest()


def segment_properties(df: DataFrame, id_col: str = "root_id", sep: str = "_") -> str:
    """A viewer's segment-property document: ids as text, one label per id of the other columns' values. Annotation tables for a viewer fit on the driver by nature; rows come sorted."""
    labels = [c for c in df.columns if c != id_col]
    text = F.concat_ws(sep, *[F.col(c).cast("string") for c in sorted(labels)])
    rows = df.select(F.col(id_col).cast("string").alias("id"), text.alias("label")).orderBy("id", "label").toLocalIterator()
    ids, values = zip(*((r.id, r.label) for r in rows)) if df.take(1) else ((), ())
    return json.dumps({"@type": "neuroglancer_segment_properties", "inline": {"ids": ids, "properties": [{"id": "label", "type": "label", "values": values}]}})


def write_properties(df: DataFrame, path: str, id_col: str = "root_id", sep: str = "_") -> bool:
    """The document of segment_properties as a text file in the folder path, in any store, unless a table with the same rows was written there; whether it was written.

    Ids and labels are put into text by the tasks that hold them, sorted by range, and one task writes the lines one by
    one: the driver sees none of them. That it is one file is the format's.
    """
    digest, spark = f"{id_col} {sep} {table_digest(df)}", df.sparkSession
    if path_exists(spark, f"{path}/digest") and spark.read.text(f"{path}/digest").first()[0] == digest:
        return False
    labels = F.concat_ws(sep, *[F.col(c).cast("string") for c in sorted(df.columns) if c != id_col])
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")
    rows = df.select(F.col(id_col).cast("string").alias("id"), labels.alias("label")).where("id IS NOT NULL")
    # Two lists in one document: ids first, then labels in the same order; a comma before all but the first of each.
    lines = rows.select(F.explode(F.array(F.struct(F.lit(1).alias("part"), quoted(F.col("id")).alias("text")), F.struct(F.lit(3).alias("part"), quoted(F.col("label")).alias("text")))).alias("l"), "id", "label").select("l.part", "id", "label", "l.text")
    frame = [(0, '{"@type": "neuroglancer_segment_properties", "inline": {"ids": ['), (2, '], "properties": [{"id": "label", "type": "label", "values": ['), (4, "]}]}}")]
    lines = lines.union(spark.createDataFrame([(p, "", "", t) for p, t in frame], "part int, id string, label string, text string"))

    def written(frames):
        before = None
        for pdf in frames:
            again = [a == b for a, b in zip(pdf["part"], [before, *pdf["part"].tolist()[:-1]])]
            yield pdf.assign(value=[("," if a and p in (1, 3) else "") + t for a, p, t in zip(again, pdf["part"], pdf["text"])])[["value"]]
            before = pdf["part"].iloc[-1] if len(pdf) else before

    lines.orderBy("part", "id", "label").coalesce(1).mapInPandas(written, "value string").write.mode("overwrite").text(f"{path}/info")
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/digest")
    return True


def write_if_changed(text: str, path: str) -> bool:
    """Writes the file unless it has this content already; whether it was written."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            if hashlib.md5(f.read()).digest() == hashlib.md5(text.encode()).digest():
                return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return True
