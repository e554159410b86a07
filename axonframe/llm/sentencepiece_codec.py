"""SentencePiece encoding and decoding, giant documents in parallel chunks.

The models at hand are of type BPE. Their pieces hold the space mark at the front only (or nothing else), so that no
merge crosses the place before a space that follows another character: texts cut there encode chunk by chunk to the very
ids of the whole. Unigram models have no such places in general; maxplus.py encodes giant documents under them.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import PIECE_BPE, partitions, slices

#: Characters from which a document is cut, and of its chunks about.
GIANT, CHUNK = 1 << 16, 1 << 14
ONE_SLICE = 1 << 20
ENCODED = "row long, doc_id long, chunk int, ids array<int>"
#: Appended to a serialized model, this sets normalizer_spec.add_dummy_prefix to false.
NO_DUMMY_PREFIX = b"\x1a\x02\x18\x00"


@functools.lru_cache(2)
def processors(path: str):
    """The model, and the same without a space before the first word: for chunks that continue a text."""
    with open(path, "rb") as f:
        raw = f.read()
    whole, rest = sentencepiece.SentencePieceProcessor(), sentencepiece.SentencePieceProcessor()
    whole.load_from_serialized_proto(raw)
    rest.load_from_serialized_proto(raw + NO_DUMMY_PREFIX)
    return whole, rest


def cut(text: str, size: int = CHUNK) -> list[str]:
    """Chunks of at least `size` characters (the last may be shorter), each but the first beginning with a space that follows another character."""
    out, at = [], 0
    while len(text) - at > size:
        stop = text.find(" ", at + size)
        while stop > 0 and text[stop - 1] in " ▁":
            stop = text.find(" ", stop + 1)
        if stop < 0:
            break
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def _encoder(path: str):
    """Adds the ids of each row's text; chunk 0 begins a document."""

    def encode(batches):
        whole, rest = processors(path)
        for batch in batches:
            for part in slices(batch, most=ONE_SLICE):
                chunk = part.column(2).to_pylist()
                ids = [np.array((rest if c else whole).encode(t, num_threads=1), np.int32) for c, t in zip(chunk, part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["row", "doc_id", "chunk", "ids"])

    return encode


def _cutter(size: int):
    def cut_rows(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = cut(text, size)
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(pieces, pa.string())], ["row", "doc_id", "chunk", "text"])

    return cut_rows


def _parts(docs: DataFrame, path: str, giant: int, chunk: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows of texts below `giant` characters, doc_id and ids of the others)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    plain = rows.where(F.length("text") < giant).select("row", "doc_id", F.lit(0).alias("chunk"), "text")
    chunks = rows.where(F.length("text") >= giant).mapInArrow(_cutter(chunk), "row long, doc_id long, chunk int, text string")
    dealt = chunks.repartition(partitions(docs.sparkSession), "row", "chunk").mapInArrow(_encoder(path), ENCODED)
    whole = dealt.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    return plain, whole.select("doc_id", "ids")


def encode_documents(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (of the whole text; null and empty texts have none).

    Texts of `giant` characters or more are cut into chunks that are dealt to all partitions, encoded apart and put
    together in order; other texts are encoded where they are read. An empty table gives no rows.
    """
    path = model or public_tokenizers.path(PIECE_BPE)
    plain, whole = _parts(docs, path, giant, chunk, id_col, text_col)
    return plain.mapInArrow(_encoder(path), ENCODED).select("doc_id", "ids").unionByName(whole)


def _decoder(path: str):
    def decode(batches):
        whole, _ = processors(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([whole.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return decode


def decode_ids(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and the text that ids spell. A text comes back as it was unless it holds the space mark U+2581, which comes back as a space."""
    return tokens.select("doc_id", "ids").mapInArrow(_decoder(model or public_tokenizers.path(PIECE_BPE)), "doc_id long, ids array<int>, text string")


def _digest(path: str, encoded: bool):
    """Encodes (unless there are ids already) and decodes in one go, so that neither ids nor texts leave the task."""

    def digest(batches):
        whole, _ = processors(path)
        for batch in batches:
            for part in [batch] if encoded else slices(batch, most=ONE_SLICE):
                rows = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "ids" if encoded else "text")))
                out = []
                for doc_id, value in rows:
                    ids = value or [] if encoded else whole.encode(value, num_threads=1)
                    out.append((doc_id, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()), hashlib.sha256(whole.decode(ids).encode()).hexdigest()))
                columns = list(zip(*out)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    return digest


def round_trip(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each whole text, as encode_documents and decode_ids do: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256."""
    path = model or public_tokenizers.path(PIECE_BPE)
    plain, whole = _parts(docs, path, giant, chunk, id_col, text_col)
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string"
    return plain.mapInArrow(_digest(path, False), schema).unionByName(whole.mapInArrow(_digest(path, True), schema))
