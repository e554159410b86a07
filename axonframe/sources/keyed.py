"""A stored table that is updated by key: rows lie in buckets of the key's hash, and an update writes the buckets it changes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.columns import require_columns
from axonframe.operators.maintenance import check_unique, upsert
from axonframe.sources.tables import path_exists


class KeyedTable:
    """A folder of Parquet buckets, and a journal that says which files of each bucket count.

    An update writes new files for the buckets of its rows' keys, beside the old ones, and then one line of the journal:
    whoever reads sees the table before or after it, never between, and a run that is killed leaves the old table. A
    journal entry is a new file that must not exist yet, so that of two writers at once one fails. An update with a
    token that the journal has already is not written again. The journal has one short line for each bucket.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _journal(self) -> tuple[int, dict]:
        """(number of the last entry, its content); (-1, empty) for a table that is not there yet."""
        if not path_exists(self.spark, f"{self.path}/journal"):
            return -1, {"files": {}, "tokens": [], "schema": None}
        path, store = self._file("journal")
        last = max((int(f.getPath().getName()) for f in store.listStatus(path) if f.getPath().getName().isdigit()), default=-1)
        if last < 0:
            return -1, {"files": {}, "tokens": [], "schema": None}
        return last, json.loads(self.spark.read.text(f"{self.path}/journal/{last:08d}", wholetext=True).first()[0])

    def _enter(self, number: int, content: dict) -> None:
        path, store = self._file(f"journal/{number:08d}")
        out = store.create(path, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, journal: tuple[int, dict], token: str, emptied: list[int]) -> None:
        last, content = journal
        name = f"data/{uuid.uuid4().hex}"
        named = rows.withColumn("bucket_of_key", self._bucket())
        named.repartition("bucket_of_key").write.partitionBy("bucket_of_key").parquet(f"{self.path}/{name}")
        path, store = self._file(name)
        made = [f.getPath().getName() for f in store.listStatus(path)]
        files = {b: f for b, f in content["files"].items() if int(b) not in emptied} | {f.rpartition("=")[2]: f"{name}/{f}" for f in made if "=" in f}
        self._enter(last + 1, {"files": files, "tokens": [*content["tokens"], token], "schema": rows.schema.json(), "buckets": self.buckets})

    def create(self, rows: DataFrame) -> None:
        """Writes the table; keys have to be unique."""
        require_columns(rows, self.key)
        check_unique(rows, self.key)
        if self._journal()[0] >= 0:
            raise ValueError(f"{self.path} is there already")
        self._write(rows, self._journal(), uuid.uuid4().hex, [])

    def _of(self, content: dict, buckets: list[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(content["schema"]))
        files = [f"{self.path}/{f}" for b, f in content["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        last, content = self._journal()
        if last < 0:
            raise ValueError(f"there is no table at {self.path}")
        return self._of(content)

    def update(self, rows: DataFrame, append: bool = False, token: str | None = None) -> list[int]:
        """Rows' columns replace those of the same keys; rows with new keys are added where append. The buckets that were written. Keys of rows have to be unique; a null key is one value."""
        check_unique(rows, self.key)
        last, content = self._journal()
        if last < 0:
            raise ValueError(f"there is no table at {self.path}")
        if token in content["tokens"]:
            return []
        self.buckets = content["buckets"]
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most as many as there are buckets
        if touched:
            before = self._of(content, touched)
            self._write(upsert(before, rows, self.key, append).select(*before.columns), (last, content), token or uuid.uuid4().hex, touched)
        return touched
