"""The edit log as a stream: incremental ingestion, windowed counts with late data, sessions, latest state per key."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.edits import affiliation_colour
from axonframe.sources.tables import OperationCache


def read_stream(spark: SparkSession, folder: str, schema: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files that arrive in a folder; the schema is that of the files there unless given."""
    schema = schema or spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def ingest(stream: DataFrame, cache: OperationCache, checkpoint: str):
    """Appends operations that the cache lacks, batch by batch; a batch that is run again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        cache.populate(df.dropDuplicates(["operation_id"]))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day", ts: str = "timestamp", by: str = "user_affiliation") -> DataFrame:
    """Edits per time window and colour of the editor's group; data later than the watermark is dropped, as streams need."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = stream.withWatermark(ts, late).groupBy(window.alias("w"), affiliation_colour(F.col(by)).alias("colour")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "colour", "n")


def edit_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day", ts: str = "timestamp", user: str = "user") -> DataFrame:
    """Runs of edits of one user with no pause of `gap` or more."""
    sessions = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_per_user(stream: DataFrame, key: str = "operation_id", user: str = "user") -> DataFrame:
    """Each user's greatest operation so far and number of operations, kept as state."""

    def update(k, frames, state):
        top, n = state.get if state.exists else (0, 0)
        for pdf in frames:
            top, n = max(top, int(pdf[key].max())), n + len(pdf)
        state.update((top, n))
        yield pd.DataFrame({user: [k[0]], "last_operation": [top], "n": [n]})

    kind = dict(stream.dtypes)[user]
    return stream.groupBy(user).applyInPandasWithState(update, f"{user} {kind}, last_operation long, n long", "last long, n long", "update", "NoTimeout")


def run_to_end(df: DataFrame, mode: str, checkpoint: str, into: str) -> DataFrame:
    """Runs a streaming query over what is there, into Parquet batches, and returns their rows with the batch's number."""
    target = os.path.join(into, "batches")

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    query = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(target)
