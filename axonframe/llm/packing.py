"""Best-fit-decreasing packing of token pieces, certified by dual feasible functions.

Pieces are dealt to groups of a fixed size and packed there. A group's lower bound (the best of several dual feasible
functions) certifies its count; what lies in loosely filled sequences of groups above their bound is exchanged: such
sequences are dealt to new groups of that size and packed again, until the bound of all pieces is met or a round gains
nothing.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import WORD_BPE, encode_words, slices, texts_of, with_end, written

CAPACITY, GROUP_PIECES = 2048, 4096
#: Rounds go on while one saves more than this part of the sequences that it was given.
LEAST_GAIN = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def _cutter(path: str, capacity: int, end_id: int):
    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                ids, first = with_end(*encode_words(part.column(1), path), end_id)
                n = np.diff(first)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                raw, a = memoryview(ids.view(np.uint8)), 4 * (first[doc] + start)
                sums = [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of at most `capacity` ids: doc_id, piece, start, length, ids_crc32. A null text is empty: one piece, the end id."""
    return texts_of(docs, id_col, text_col).mapInArrow(_cutter(tokenizer or public_tokenizers.path(WORD_BPE), capacity, end_id), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's bin and its place there."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free_of: dict[int, list[int]] = {}
    frees: list[int] = []
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(frees, size)
        if at < len(frees):
            free = frees[at]
            b = free_of[free].pop()
            if not free_of[free]:
                del free_of[free], frees[at]
        else:
            free, b, made = capacity, made, made + 1
        bins[i], places[i] = b, capacity - free
        if free > size:
            if free - size not in free_of:
                free_of[free - size] = []
                insort(frees, free - size)
            free_of[free - size].append(b)
    return bins, places


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best bound of the identity, of u_k (k up to 20) and of f_eps (every eps up to half a bin)."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 21):
        exact = size * (k + 1) % capacity == 0
        scaled = np.where(exact, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    number, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    eps = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - eps + 1]
    middle = total[capacity - eps + 1] - total[eps]
    return max(best, int((large + -(-middle // capacity)).max())) if count.any() else 0


PACKED = f"row long, {PIECES}, part long, sequence_id long, offset long, exchange boolean"


def _packer(capacity: int, round_no: int):
    """Packs a group's pieces, unless their present packing is as good; marks those to exchange."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("length", "descending"), ("row", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        names = (round_no << 52) + (table["part"][0].as_py() << 22) + bins
        before = table["sequence_id"]
        if not before.null_count and bins.max() + 1 >= len(before.unique()):
            names, offsets = before.to_numpy(), table["offset"].to_numpy()
        _, bins = np.unique(names, return_inverse=True)
        fills = np.bincount(bins, weights=lengths).astype(np.int64)
        certified = len(fills) == lower_bound(lengths, capacity)
        loose = fills == fills.min() if certified else fills < capacity - capacity // 64
        exchange = loose[bins] & (len(fills) * capacity > lengths.sum())
        columns = [table[c] for c in ("row", "doc_id", "piece", "start", "length", "ids_crc32", "part")]
        return pa.Table.from_arrays([*columns, pa.array(names), pa.array(offsets), pa.array(exchange)], [*table.column_names[:6], "part", "sequence_id", "offset", "exchange"])

    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, rounds: int | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the packing's certificate: n_sequences, the number of all sequences, and least_sequences, a lower bound of any packing's number.

    Only documents of over `capacity` ids are cut; full pieces are sequences of their own. A null text is empty (its end
    id is packed). Repeated rows are packed as often as they occur; ids may be null. An empty table gives no rows.
    Groups hold about group_pieces pieces at any size of input and in every round; pieces are five numbers, and texts
    never move. Sequences move whole. Rounds end when the bound is met, when one saves no sequence (or less than a LEAST_GAIN-th
    of those it was given), when one group held all that was left, or after `rounds` of them.
    """
    pieces = written(cut_pieces(docs, capacity, end_id, tokenizer, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    count = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # as many rows as there are lengths
        count[length] = n
    n_full, count[capacity] = int(count[capacity]), 0
    least, left = bound_of_counts(count, capacity), int(count.sum())
    rest = rest.select("row", *PIECE_COLUMNS, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    placed = [full.select(*PIECE_COLUMNS, (F.col("row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    opened = kept = r = 0
    while left:
        groups = -(-left // group_pieces)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(r), F.coalesce("sequence_id", "row")), F.lit(groups)))
        packed = written(dealt.groupBy("part").applyInArrow(_packer(capacity, r), PACKED), f"packed-{r}")
        opens = F.when(F.col("offset") == 0, 1).otherwise(0)
        here, moving, left = packed.agg(F.sum(opens), F.sum(F.when(F.col("exchange"), opens).otherwise(0)), F.count(F.when(F.col("exchange"), 1))).first()
        r += 1
        done = not left or groups == 1 or kept + here == least or r == rounds or r > 1 and opened - here <= opened // LEAST_GAIN
        placed.append((packed if done else packed.where("NOT exchange")).select(*PIECE_COLUMNS, "sequence_id", "offset"))
        if done:
            kept += here
            break
        kept, opened, rest = kept + here - moving, moving, packed.where("exchange").drop("part", "exchange")
    return functools.reduce(DataFrame.unionByName, placed).withColumns({"n_sequences": F.lit(kept + n_full).cast("long"), "least_sequences": F.lit(least + n_full).cast("long")})
