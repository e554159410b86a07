"""Unigram encoding of giant documents by a max-plus scan over chunks.

Under a unigram model a text's best segmentation maximises the sum of its pieces' scores. A chunk of the text is a
matrix over boundary states: the state at a boundary is how many characters the piece that crosses it reaches beyond.
Entry [i, j] is the best score from state i at the chunk's start to state j at its end; such matrices combine by
max-plus products, which are associative. With the best scores at each chunk's start known, chunks are backtraced apart:
each gives, for every state at its end, the state at its start, and composing these fixes the path.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import partitions

CHUNK = 4096
#: Appended to a serialized model, this sets trainer_spec.model_type to unigram.
AS_UNIGRAM = b"\x12\x02\x18\x01"
UNKNOWN_PENALTY = 10.0
LOW = -np.inf


class Vocabulary:
    """Pieces and scores of a unigram model, with the longest piece's length; an unknown character costs the least score less a penalty and becomes bytes."""

    def __init__(self, raw: bytes):
        model = sentencepiece.SentencePieceProcessor()
        model.load_from_serialized_proto(raw)
        self.pieces, self.bytes = {}, {}
        least = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece] = (model.get_score(i), i)
                least = min(least, model.get_score(i))
        self.unknown = least - UNKNOWN_PENALTY
        self.reach = max(map(len, self.pieces))

    def steps(self, text: str, at: int) -> list[tuple[int, float, int]]:
        """(length, score, id) of pieces at a place; id -1 for a character that no piece of one character covers."""
        found = [(k, *self.pieces[text[at : at + k]]) for k in range(1, min(self.reach, len(text) - at) + 1) if text[at : at + k] in self.pieces]
        return found if found and found[0][0] == 1 else [(1, self.unknown, -1), *found]

    def ids(self, text: str, at: int, length: int, number: int) -> list[int]:
        return [self.bytes[b] for b in text[at : at + length].encode()] if number < 0 else [number]


def forward(vocabulary: Vocabulary, text: str, size: int, start: np.ndarray) -> tuple[np.ndarray, list]:
    """Best scores at the places 0 .. size + reach - 1 from the given ones at the first `reach` places (rows: alternatives), and each place's best last step in every row.

    text: the chunk's characters, `size` of them, and what follows as far as a piece can reach. Of equal scores the
    earliest start of the last piece wins.
    """
    room = size + vocabulary.reach
    best = np.full((room, len(start)), LOW)
    best[: vocabulary.reach] = start.T
    last = [[None] * len(start) for _ in range(room)]
    for at in range(size):
        for length, score, number in vocabulary.steps(text, at):
            to, value = at + length, best[at] + score
            for r in np.flatnonzero(value > best[to]):
                best[to, r], last[to][r] = value[r], (at, length, number)
    return best, last


def transfer(vocabulary: Vocabulary, text: str, size: int) -> np.ndarray:
    """The chunk's matrix over boundary states."""
    n = vocabulary.reach
    start = np.full((n, n), LOW)
    np.fill_diagonal(start, 0.0)
    return forward(vocabulary, text, size, start)[0][size : size + n].T


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def backtrace(vocabulary: Vocabulary, text: str, size: int, start: np.ndarray, state: int) -> tuple[int, list[int]]:
    """From a state at the chunk's end: the state at its start, and the ids of the pieces that begin in the chunk."""
    _, last = forward(vocabulary, text, size, start[None])
    at, out = size + state, []
    while last[at][0] is not None:
        begin, length, number = last[at][0]
        out.append(vocabulary.ids(text, begin, length, number))
        at = begin
    return at, [i for ids in reversed(out) for i in ids]


@functools.lru_cache(2)
def vocabulary_of(path: str, as_unigram: bool) -> Vocabulary:
    with open(path, "rb") as f:
        raw = f.read()
    return Vocabulary(raw + AS_UNIGRAM if as_unigram else raw)


def encode_giant(texts: DataFrame, model: str, as_unigram: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(key, ids) of texts(key long, text), each key once, under a unigram model with space marks and a dummy first space.

    Texts are cut anywhere. Their matrices are made apart, combined per text (a small matrix per chunk, never text),
    and each chunk is backtraced apart. as_unigram reads a model of another type as if its scores were a unigram model's.
    Null and empty texts have no ids.
    """
    reach = vocabulary_of(model, as_unigram).reach

    def cut(batches):
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                marked = "▁" + text.replace(" ", "▁") if text else ""
                at = list(range(0, len(marked), chunk))
                sizes = [min(chunk, len(marked) - a) for a in at]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array(range(len(at)), pa.int32()), pa.array(sizes, pa.int32()), pa.array([marked[a : a + chunk + reach] for a in at], pa.string())], ["key", "chunk", "size", "text"])

    def matrices(batches):
        own = vocabulary_of(model, as_unigram)
        for batch in batches:
            for key, number, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([number], pa.int32()), pa.array([transfer(own, text, size).ravel()])], ["key", "chunk", "matrix"])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        scores = np.full((1, reach), LOW)
        scores[0, 0], out = 0.0, []
        for m in pdf["matrix"]:
            out.append(scores[0].copy())
            scores = combine(scores, np.reshape(m, (reach, reach)))
        return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "start": out})

    def maps(batches):
        own = vocabulary_of(model, as_unigram)
        for batch in batches:
            for key, number, size, text, start in zip(*(c.to_pylist() for c in batch.columns)):
                ends = [backtrace(own, text, size, np.array(start), j)[0] for j in range(reach)]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([number], pa.int32()), pa.array([ends], pa.list_(pa.int32()))], ["key", "chunk", "entry"])

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", ascending=False)
        state, out = 0, []
        for entry in pdf["entry"]:
            out.append(state)
            state = int(entry[state])
        return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "state": out})

    def emit(batches):
        own = vocabulary_of(model, as_unigram)
        for batch in batches:
            for key, number, size, text, start, state in zip(*(c.to_pylist() for c in batch.columns)):
                ids = backtrace(own, text, size, np.array(start), state)[1]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], ["key", "chunk", "ids"])

    n = partitions(texts.sparkSession)
    chunks = texts.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, "key long, chunk int, size int, text string").repartition(n, "key", "chunk")
    scored = chunks.mapInArrow(matrices, "key long, chunk int, matrix array<double>")
    started = chunks.join(scored.groupBy("key").applyInPandas(starts, "key long, chunk int, start array<double>"), ["key", "chunk"])
    states = started.mapInArrow(maps, "key long, chunk int, entry array<int>").groupBy("key").applyInPandas(path, "key long, chunk int, state int")
    ids = started.join(states, ["key", "chunk"]).mapInArrow(emit, "key long, chunk int, ids array<int>")
    whole = ids.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    return texts.select("key").join(whole, "key", "left").select("key", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
