"""Helpers shared by the operators: the shared folder, hot-safe materialising, word splitting and encoding."""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Bytes of text that one vectorised step handles at once.
SLICE_BYTES = 4 << 20
#: Entries of a Python worker's word cache; beyond this, words met in one slice only are forgotten.
CACHE_WORDS = 600_000
LINE_WORDS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode, where there is one machine only, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="axonframe-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that written() gave and that nothing will read again."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name beginning with base that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([base], (f"{base}_{i}" for i in itertools.count())) if n.lower() not in taken)


def with_groups(rows: DataFrame, groups: DataFrame, on: dict[str, str], size: str, total: int, spread: str) -> DataFrame:
    """Left join of rows with their groups (one row for each key, columns all different from those of rows), on: row column -> group column.

    `size` says how many rows a group has, `total` how many there are. Groups of more than a fourth of a partition's fair
    share are at most four times as many as there are partitions: these are broadcast, and their rows, which no longer
    need a partner from the shuffle, are dealt by `spread` over all partitions. All other groups are shuffled.
    """
    many = partitions(rows.sparkSession)
    bound = max(1, total // (4 * many))
    hot = groups.where(F.col(size) > bound).select(*(F.col(c).alias(f"hot_{c}") for c in groups.columns))
    cold = groups.where(F.col(size) <= bound).withColumn("cold_salt", F.lit(0))
    first = next(iter(on.values()))
    near = rows.join(F.broadcast(hot), functools.reduce(Column.__and__, [F.col(r) == F.col(f"hot_{g}") for r, g in on.items()]), "left")
    near = near.withColumn("row_salt", F.when(F.col(f"hot_{first}").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(many))).cast("int"))
    keys = functools.reduce(Column.__and__, [F.col(r) == F.col(g) for r, g in on.items()], F.col("row_salt") == F.col("cold_salt"))
    return near.join(cold, keys, "left").select(*rows.columns, *(F.coalesce(f"hot_{c}", c).alias(c) for c in groups.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts empty; other columns, whatever their names, stay behind."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def as_arrow(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """The batch in runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    pa.default_memory_pool().release_unused()


def outside(spans: list, covers: list) -> list:
    """The spans (start, end, ...) that lie within none of covers; both in order of start, each is passed over once."""
    left, reach, at = [], -1, 0
    for span in spans:
        while at < len(covers) and covers[at][0] <= span[0]:
            reach, at = max(reach, covers[at][1]), at + 1
        if span[1] > reach:
            left.append(span)
    return left


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts in one array, and each text's first place in it (one more at the end)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=counts[1:])
    return flat.filter(full), counts[offsets]


#: A word of letters and digits with a run of ASCII punctuation behind it. Letters that turn into several characters when
#: normalised or lower-cased (İ among them) are not in the ranges.
_TAILED = r"^(?P<stem>[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{410}-\x{44F}]+)(?P<tail>[!-/:-@\[-`{-~]+)$"


class WordIds:
    """Ids of words, kept for later batches of the same Python worker: all ids lie in one array, a part of a word is a number.

    White space never joins two words' ids, nor does a run of punctuation that ends a word of letters and digits, so
    that stems and tails are encoded apart, once each. The tokenizer sees words as they are written: special tokens are
    matched in exactly their own case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.parts: dict[str, int] = {"": 0}
        self.size, self.start, self.pool = np.zeros(1, np.int32), np.zeros(1, np.int64), np.empty(0, np.int32)
        self.met = np.full(1, 2, np.int32)

    def forget(self) -> None:
        """Keeps the words that several slices held."""
        stay = self.met > 1
        stay[0] = True
        new = np.cumsum(stay) - 1
        self.parts = {w: int(new[n]) for w, n in self.parts.items() if stay[n]}
        self.pool, ends = gather(self.pool, self.start[stay], self.size[stay])
        self.start, self.size, self.met = ends[:-1].copy(), self.size[stay], np.minimum(self.met[stay], 4) // 2
        self.met[0] = 2

    def _encoded(self, words: list[str]) -> tuple[list[str], list[list[int]]]:
        """The words, in some order, and their ids. Words of letters are encoded many to a line, as each ends with a token that ends a word; a line with more such tokens than words is encoded word by word."""
        plain, rest = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        order, ids = [], []
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            row = e.ids
            stops = np.flatnonzero(self.ends[row]) + 1
            if len(stops) != len(line):
                rest += line
                continue
            order += line
            ids += [row[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
        return order + rest, ids + [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.parts
        if new := [w for w in words if w not in known]:
            new, got = self._encoded(new)
            size = np.fromiter(map(len, got), np.int32, len(got))
            known.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size, dtype=np.int64) - size])
            self.size = np.concatenate([self.size, size])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
            self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(got), np.int32, int(size.sum()))])
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.met[number] += 1
        return number[coded.indices.to_numpy()]

    def runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and where each word's end (a zero first)."""
        if len(self.parts) > CACHE_WORDS:
            self.forget()
        split = pc.extract_regex(words, _TAILED)
        stem, tail = pc.coalesce(pc.struct_field(split, "stem"), words), pc.coalesce(pc.struct_field(split, "tail"), "")
        both = np.column_stack([self._numbers(stem), self._numbers(tail)]).ravel()
        ids, ends = gather(self.pool, self.start[both], self.size[both])
        return ids, ends[::2]


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[start : start + size], one after the other, and where each ends (a zero first)."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    place = np.repeat((start - ends[:-1]).astype(np.int32), size)
    place += np.arange(ends[-1], dtype=np.int32)
    return pool[place], ends


_cached: list[WordIds] = []


def encode_words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts, one after the other, and each text's first place among them (one more at the end)."""
    if not _cached or _cached[0].path != path:
        _cached[:] = [WordIds(path)]
    words, first = split_words(texts)
    coded = words.dictionary_encode()
    pool, ends = _cached[0].runs(coded.dictionary)
    code = coded.indices.to_numpy()
    ids, ends = gather(pool, ends[:-1][code], np.diff(ends)[code])
    return ids, ends[first]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    return np.insert(ids, first[1:], end).astype(np.int32), first + np.arange(len(first))
