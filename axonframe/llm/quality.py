"""Document quality by histogram gradient-boosted trees over text statistics.

The trees are fitted with numpy on a bounded sample of labelled rows and flattened into arrays, so that a batch of
documents is scored by one vectorised step per tree level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import slices, split_words, texts_of

#: Labelled rows to learn from at most (those with the least hashes of their ids).
MAX_TRAIN_ROWS = 20_000
FOLDS, HELD_OUT_FOLD = 3, 1
TREES, DEPTH, BINS, RATE, RIDGE, MIN_WEIGHT = 80, 4, 64, 0.15, 1.0, 4.0

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "bar", "symbol", "bracket", "other_ascii", "high",
    "distinct_words", "distinct_pairs", "same_next", "long_words", "capital_words",
]
_CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "bar", "symbol", "bracket", "other_ascii", "high"]


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other_ascii"), np.uint8)
    table[128:] = _CLASSES.index("high")
    for name, chars in (("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("space", b" \t"), ("newline", b"\n\r\x0b\x0c"), ("stop", b".?"), ("comma", b",;:"), ("bang", b"!"), ("bar", b"|"), ("symbol", b"#$%&*@^~"), ("bracket", b"<>{}[]()/\\")):
        table[list(chars)] = _CLASSES.index(name)
    return table


_TABLE = _byte_classes()


def _distinct(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Different codes of each document."""
    keys = np.unique(doc * (int(code.max()) + 1) + code) if len(code) else code
    return np.bincount(keys // (int(code.max()) + 1), minlength=n) if len(code) else np.zeros(n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text; shares of an empty text are zero."""
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    k = len(_CLASSES)
    counts = np.bincount(np.repeat(np.arange(n) * k, size) + _TABLE[raw], minlength=n * k).reshape(n, k)
    words, first = split_words(texts)
    number = np.diff(first)
    doc = np.repeat(np.arange(n), number)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    inside = doc[1:] == doc[:-1]
    pairs = code[:-1][inside] * (int(code.max(initial=0)) + 1) + code[1:][inside]
    pair_code = np.unique(pairs, return_inverse=True)[1] if len(pairs) else pairs
    starts = np.cumsum(length) - length
    letters = np.frombuffer(words.buffers()[2], np.uint8)[np.frombuffer(words.buffers()[1], np.int32)[words.offset] :] if len(words) else np.empty(0, np.uint8)
    capital = (letters[starts] >= 65) & (letters[starts] <= 90) if len(words) else np.zeros(0, bool)
    per = lambda x, by: x / np.maximum(by, 1)
    many = np.maximum(number - 1, 1)
    columns = [
        np.log1p(size), np.log1p(number), per(size, number), *(per(counts[:, i], size) for i in range(k)),
        per(_distinct(doc, code, n), number), _distinct(doc[1:][inside], pair_code, n) / many, np.bincount(doc[1:][inside], weights=code[1:][inside] == code[:-1][inside], minlength=n) / many,
        per(np.bincount(doc, weights=length > 12, minlength=n), number), per(np.bincount(doc, weights=capital, minlength=n), number),
    ]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Complete binary trees in flat arrays: node i has children 2i + 1 and 2i + 2; a value above its threshold goes right."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees under logistic loss; each level's splits come from one histogram over (node, feature, bin)."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    rate = np.clip(y.mean(), 0.01, 0.99) if n else 0.5
    inner = 2**depth - 1
    model = Trees(float(np.log(rate / (1 - rate))), np.zeros((trees if n else 0, inner), np.int64), np.full((trees if n else 0, inner), np.inf), np.zeros((trees if n else 0, inner + 1)))
    if not n:
        return model
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    binned = np.column_stack([np.searchsorted(edges[:, f], x[:, f], side="left") for f in range(width)])
    cell = binned + np.arange(width) * BINS
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            begin, many = 2**level - 1, 2**level
            keys = ((node - begin)[:, None] * width * BINS + cell).ravel()
            sums = [np.bincount(keys, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS) for v in (grad, hess)]
            left_g, left_h = (np.cumsum(s, axis=2)[:, :, :-1] for s in sums)
            all_g, all_h = (s.sum(axis=2)[:, :, None] for s in sums)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain = np.where((left_h >= MIN_WEIGHT) & (right_h >= MIN_WEIGHT), gain, 0).reshape(many, -1)
            best = gain.argmax(axis=1)
            feature, cut = best // (BINS - 1), best % (BINS - 1)
            split = gain[np.arange(many), best] > 1e-6
            model.feature[t, begin : begin + many] = feature
            model.threshold[t, begin : begin + many] = np.where(split, edges[cut, feature], np.inf)
            own = node - begin
            node = 2 * node + 1 + (split[own] & (binned[np.arange(n), feature[own]] > cut[own]))
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        model.leaf[t] = -RATE * g / (h + RIDGE)
        margin += model.leaf[t][leaf]
    return model


def held_out(doc_id, folds: int, fold: int):
    """crc32 of the id as text, modulo folds, is fold; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def sampled_labels(labels: DataFrame, label: str, folds: int, fold: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """(label_id, y) of at most `most` rows outside the held-out fold, those with the least hashes; rows without id or label are left out."""
    rows = labels.select(labels[id_col].cast("long").alias("label_id"), labels[label].cast("double").alias("y")).where("label_id IS NOT NULL AND y IS NOT NULL")
    rows = rows.where(~held_out(F.col("label_id"), folds, fold))
    return rows.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees learned from labels.quality of rows outside the held-out fold, at most `most` of them, and of rows that share an id and a label one; no row: a constant of one half."""
    sample = F.broadcast(sampled_labels(labels, "quality", FOLDS, HELD_OUT_FOLD, most))
    rows = texts_of(docs, id_col, text_col).join(sample, F.col("doc_id") == F.col("label_id"))
    vectors = rows.select("label_id", "y", "text").mapInArrow(_vectors_with_label, "label_id long, y double, x array<double>")
    return fit_trees(*in_order(vectors.groupBy("label_id", "y").agg(F.min("x").alias("x")).toPandas(), len(FEATURES)))


def in_order(learned, width: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the sample in one order, however its rows came in."""
    x, y = np.array(learned["x"].tolist()).reshape(-1, width), learned["y"].to_numpy(float)
    order = np.lexsort(np.column_stack([x, y]).T)
    return x[order], y[order]


def _vectors_with_label(batches):
    for batch in batches:
        for part in slices(batch):
            x = statistics(part.column(2))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["label_id", "y", "x"])


def _scorer(model: Trees):
    def score(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(part.column(1))))], ["doc_id", "score"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5).

    Only the text is scored, the whole of it; null is the empty text. A null id is not held out. Without labels to learn
    from each score is one half. Labels of one id that differ all count. An empty table gives no rows.
    """
    model = fit(docs, labels, most, id_col, text_col)
    rows = texts_of(docs, id_col, text_col).mapInArrow(_scorer(model), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of 0.5 or more, all columns, whatever their names. Rows are scored one by one, so equal ids need not share a fate. A null text is scored as the empty one and stays null. An empty table stays empty; without labels all scores are one half and every row stays."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    def good(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(part.schema.get_field_index(text_col)).fill_null("")
                yield part.filter(pa.array(model.score(statistics(texts)) >= 0.5))

    return docs.mapInArrow(good, docs.schema)
