"""Token ids in ORC: integer run-length encoded columns, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonframe.llm.common import WORD_BPE, encode_words, partitions, shared_path, slices, texts_of, with_end

SCHEMA = "doc_id long, place long, n_tokens long, ids array<int>"
OPTIONS = {"orc.compress": "ZSTD", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def _encoder(path: str, end_id: int):
    def encode(batches):
        for batch in batches:
            for part in slices(batch):
                ids, first = with_end(*encode_words(part.column(2), path), end_id)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first)), lists], ["doc_id", "place", "n_tokens", "ids"])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each whole text's ids, end_id last, in ascending doc_id order over all files (null ids first, equal ids by text).

    A null text is empty and has the end id alone. `place` ascends with the order and holds the file's number above its
    low 33 bits. Documents stay whole: stripes can be read apart, and readers skip them by doc_id. No rows: no stripes.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(WORD_BPE)
    ordered = texts_of(docs, id_col, text_col).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.select("doc_id", F.monotonically_increasing_id().alias("place"), "text").mapInArrow(_encoder(tokenizer, end_id), SCHEMA)
    rows.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def _checksums(batches):
    for batch in batches:
        lists = batch.column(2)
        at, raw = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().view(np.uint8))
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "place", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only each file's sum meets the other files' sums; within a file the sums run in file order.
    """
    shard = F.shiftright("place", 33)
    rows = read_tokens(spark, path).select("doc_id", "place", "ids").mapInArrow(_checksums, "doc_id long, place long, n_tokens long, ids_crc32 long").withColumn("shard", shard)
    sums = read_tokens(spark, path).groupBy(shard.alias("of")).agg(F.sum("n_tokens").alias("n"))
    before = sums.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("within", F.coalesce(within, F.lit(0))).join(before, F.col("shard") == F.col("of")).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_orc(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files (to the shared folder by default) and returns token_index of them."""
    path = path or shared_path(docs.sparkSession, "token-orc")
    write_tokens(docs, path, **options)
    return token_index(docs.sparkSession, path)
