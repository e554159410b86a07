"""Quality rules: base counts of a text, and lines that too many documents of one host share.

Each text is measured once. Its lines are normalised (A-Z to a-z, words joined by one space) and hashed to 128 bits, and
the table of measures and hashes is written down; texts don't move again. A line's count is that of the different texts
of its host that hold it, so that copies of one document count once. Counts are combined before each shuffle, and rows of
hot lines and hot hosts are dealt over all partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import slices, split_words, with_groups, written

#: A line goes if more than LEAST different texts of its host hold it, and more than SHARE of them all.
LEAST, SHARE = 10, 0.02
#: A document is depleted if more than this share of its words stands in such lines.
DEPLETED = 0.5
MIN_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = "[#*$%&|<>]"
_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, t1 long, t2 long, lines array<struct<h1: long, h2: long, words: int>>"


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair, the same for equal pairs."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _halves(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(v) for v in values), ">i8").astype(np.int64).reshape(-1, 2)


def repeat_words(code: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, the number of words in windows that the text holds more than once. code: the words' numbers; first: each text's first place (one more at the end)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(np.arange(len(code)) + window <= first[doc + 1]) if len(code) else np.empty(0, np.int64)
    key = doc[starts]
    for k in range(window):
        key = _both(key, code[starts + k])
    again = starts[np.bincount(key)[key] > 1] if len(key) else starts
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(doc[covered], minlength=len(first) - 1)


def _lines(texts: pa.Array):
    """All texts' lines, each line's text, the lines' words, and each line's first place among them (one more at the end)."""
    lists = pc.split_pattern(texts, "\n")
    flat, offsets = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()), lists.offsets.to_numpy()
    words, first = split_words(flat)
    return flat, np.repeat(np.arange(len(texts)), np.diff(offsets)), words, first


def _normalised(words: pa.Array, first: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pc.ascii_lower(words)), " ")


def _measured(texts: pa.Array) -> list[pa.Array]:
    """The columns of _MEASURES."""
    n = len(texts)
    flat, of, words, first = _lines(texts)
    size = np.diff(first)
    n_words = np.bincount(of, size, n).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n_words)])
    chars = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64))])
    full = np.flatnonzero(size)
    raw = _both(of[full], flat.take(pa.array(full)).dictionary_encode().indices.to_numpy())
    different = np.unique(raw, return_index=True)[1]
    dup = np.bincount(of[full], minlength=n) - np.bincount(of[full][different], minlength=n)
    coded = words.dictionary_encode().indices.to_numpy()
    normal = _normalised(words, first).take(pa.array(full)).dictionary_encode()
    line = _both(of[full], normal.indices.to_numpy())
    one, at = np.unique(line, return_index=True)
    total = np.bincount(line, size[full], len(one)).astype(np.int32)
    halves = _halves([s.encode() for s in normal.dictionary.to_pylist()])[normal.indices.to_numpy()[at]]
    order = np.argsort(of[full][at], kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(of[full][at], minlength=n))])
    listed = pa.StructArray.from_arrays([pa.array(halves[order, 0]), pa.array(halves[order, 1]), pa.array(total[order])], ["h1", "h2", "words"])
    whole = _halves([s.encode() for s in texts.to_pylist()])
    counts = [n_words, np.diff(chars[starts]), pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64), dup, repeat_words(coded, starts)]
    return [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), listed)]


def _measure(batches):
    for batch in batches:
        for part in slices(batch):
            text = part.schema.get_field_index("text")
            kept = [i for i in range(part.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *_measured(part.column(text))], [*(part.schema.names[i] for i in kept), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "t1", "t2", "lines"])


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def frequent_lines(measured: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(of_host, of_h1, of_h2, rows) of the lines above the limits; measured: as the table of measures, one row for each document."""
    hosts = measured.groupBy(F.col("host").alias("of_host")).agg(F.count_distinct("t1", "t2").alias("host_texts"), F.count(F.lit(1)).alias("host_rows"))
    lines = measured.select("host", "t1", "t2", F.explode("lines").alias("line")).select("host", F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2"), "t1", "t2")
    counts = lines.groupBy("host", "h1", "h2").agg(F.count_distinct("t1", "t2").alias("texts"), F.count(F.lit(1)).alias("rows")).where(F.col("texts") > least)
    placed = with_groups(counts, hosts, {"host": "of_host"}, "host_rows", measured.count(), "h1")
    return placed.where(F.col("texts") > share * F.col("host_texts")).select("of_host", F.col("h1").alias("of_h1"), F.col("h2").alias("of_h2"), F.col("rows"))


def _placed(measured: DataFrame, least: int, share: float) -> DataFrame:
    """(row, h1, h2, words) of the lines above the limits in each document."""
    frequent = written(frequent_lines(measured, least, share), "frequent")
    lines = measured.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2"), F.col("line.words").alias("words"))
    met = with_groups(lines, frequent, {"host": "of_host", "h1": "of_h1", "h2": "of_h2"}, "rows", lines.count(), "row")
    return met.where("rows IS NOT NULL").select("row", "h1", "h2", "words")


def _judged(rows: DataFrame, least: int, share: float, depleted: float) -> tuple[DataFrame, DataFrame]:
    """(each row's measures and verdict, the frequent lines in each)."""
    measured = written(rows.mapInArrow(_measure, f"row long, doc_id long, host string, {_MEASURES}"), "measures")
    found = _placed(measured, least, share)
    gone = found.groupBy(F.col("row").alias("of_row")).agg(F.sum("words").alias("n_removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = measured.join(gone, F.col("row") == F.col("of_row"), "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_removed") <= depleted * F.col("n_words")))
    return out, found


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LEAST, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed (words in lines above the limits).

    Null texts are empty, have no words and fail; a null host is the empty one; null ids stay null; repeated rows are
    judged alike. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return _judged(_rows(docs, id_col, text_col, host_col), least, share, depleted)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def _without(batches):
    for batch in batches:
        for part in slices(batch):
            names = part.schema.names
            texts, gone = part.column(names.index("text")), part.column(names.index("gone"))
            out = []
            for text, keys in zip(texts.to_pylist(), gone.to_pylist()):
                if keys:
                    known, lines = {(k["h1"], k["h2"]) for k in keys}, text.split("\n")
                    words, first = split_words(pa.array(lines))
                    halves = _halves([s.encode() for s in _normalised(words, first).to_pylist()]).tolist()
                    text = "\n".join(s for s, h, n in zip(lines, halves, np.diff(first)) if not n or tuple(h) not in known)
                out.append(text)
            yield pa.RecordBatch.from_arrays([part.column(names.index("doc_id")), part.column(names.index("host")), pa.array(out, pa.string())], ["doc_id", "host", "text"])


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LEAST, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """(doc_id, host, text) of the documents that quality_rules keeps, without the lines above the limits; lines without a word stay. The texts are written to the shared folder with their row numbers, by which verdicts and lines find them."""
    held = written(_rows(docs, id_col, text_col, host_col), "lined")
    judged, found = _judged(held, least, share, depleted)
    gone = found.groupBy(F.col("row").alias("at_row")).agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    kept = judged.where("kept").select(F.col("row").alias("kept_row"))
    texts = held.join(kept, F.col("row") == F.col("kept_row"), "left_semi").join(gone, F.col("row") == F.col("at_row"), "left")
    return texts.select("doc_id", "host", "text", "gone").mapInArrow(_without, "doc_id long, host string, text string")
