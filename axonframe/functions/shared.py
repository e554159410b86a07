"""Cutting lineage where a table is used again or must not be made twice, and names that no column has."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode, where there is one machine only, and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="axonframe-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, so that what reads it prunes columns and skips row groups; dropped() deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that stored() gave and that nothing will read again."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(base: str, *tables: DataFrame) -> str:
    """A column name beginning with base that none of the tables has, in whatever case."""
    taken = {c.lower() for t in tables for c in t.columns}
    return next(n for n in itertools.chain([base], (f"{base}_{i}" for i in itertools.count())) if n.lower() not in taken)
