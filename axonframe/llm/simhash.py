"""SimHash near-duplicates: Golay-code fuzzy keys of fingerprint segments, joined and verified.

A 64-bit fingerprint has three segments of at most 22 bits. Two fingerprints at 4 or fewer differing bits have two
segments with at most 2 differing bits together: one equal and one within 2, or both at exactly 1. In the second case
the third segment differs by at most 2 bits, so that one of its three parts is equal, and the two segments' parities
flip together. The perfect Golay code [23, 12, 7] turns nearness of a segment into equality of a 12-bit codeword index.
Words within 2 bits share a codeword at distance 4 or less, of which a word has 1 or 6; words within 1 bit share the
greater of their nearest codewords. Keys have 33 bits or more beside their kind.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import fresh, slices, split_words, texts_of, written
from axonframe.llm.components import components, named

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Low bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GENERATOR = 0b110001110101
#: Low bit and width of each part of a segment.
PARTS = ((0, 7), (7, 7), (14, 8))
#: Rows of keys that one step verifies at once; only a single key with more of them is held beyond it.
VERIFY_ROWS = 1 << 20
#: Keys' buckets up to this size compare all their pairs; larger ones grow components from one member at a time.
SMALL_BUCKET = 16


def majorities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes, which begin at first (one more at the end) and are none of them empty, the bits set in over half of it."""
    if len(first) < 2:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first[:-1], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.diff(first)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    words, first = split_words(pc.ascii_lower(texts))
    spaced = pc.binary_join_element_wise(words, "", " ") if len(words) else words
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False))]).astype(np.int64)
    base = spaced.offset if len(words) else 0
    buffers = spaced.buffers()
    begin = int(np.frombuffer(buffers[1], np.int32)[base]) if len(words) else 0
    data = buffers[2].to_pybytes()[begin : begin + int(offsets[-1])] if len(words) else b""
    n = np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    i = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start, stop = offsets[i], offsets[np.minimum(i + shingle, first[doc + 1])] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(doc))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(count)
    out[some] = majorities(hashes, np.concatenate([[0], np.cumsum(count[some])]))
    return out.view(np.int64)


def _fingerprint(batches):
    for batch in batches:
        for part in slices(batch, most=2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1)))], ["doc_id", "fp"])


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity bits of each 12-bit message; each syndrome's error of weight 3 or less; its five errors of weight 4, or that error again."""
    message = np.arange(1 << 12, dtype=np.int64)
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << (bit - 11), rest)
    parity = rest
    bits = 1 << np.arange(23, dtype=np.int64)
    syndrome = lambda e: (e & 0x7FF) ^ parity[e >> 11]
    sums = {0: np.zeros(1, np.int64)}
    for w in range(1, 5):
        grown = (sums[w - 1][:, None] ^ bits).ravel()
        sums[w] = np.unique(grown[np.bitwise_count(grown) == w])
    near = np.zeros(1 << 11, np.int64)
    for w in range(4):
        near[syndrome(sums[w])] = sums[w]
    far = np.repeat(near[:, None], 5, axis=1)
    s = syndrome(sums[4])
    order = np.argsort(s, kind="stable")
    far[s[order], np.arange(len(s)) - np.searchsorted(s[order], s[order])] = sums[4][order]
    return parity, near, far


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each 23-bit word: 6 columns, the nearest one first, repeated where there are fewer."""
    parity, near, far = golay()
    s = (words & 0x7FF) ^ parity[words >> 11]
    return np.column_stack([(words ^ near[s]) >> 11, (words[:, None] ^ far[s]) >> 11])


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of fps): two fingerprints at 4 or fewer differing bits share a key at least."""
    parts = [(fps.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    codes = [codewords(p) for p in parts]
    at_least = [np.maximum(c, c[:, :1]) for c in codes]
    blocks = []
    for kind, (s, t) in enumerate((s, t) for s in range(3) for t in range(3) if s != t):
        blocks.append((kind << 40) | (parts[s][:, None] << 12) | codes[t])
        if s < t:
            both = ((at_least[s][:, :, None] << 12) | at_least[t][:, None, :]).reshape(len(fps), 36)
            odd = (np.bitwise_count(parts[s]) + np.bitwise_count(parts[t]) & 1).astype(np.int64)
            for p, (low, width) in enumerate(PARTS):
                rest = (p << 9) | (odd << 8) | (parts[3 - s - t] >> low & ((1 << width) - 1))
                blocks.append(((8 + kind) << 40) | (rest[:, None] << 24) | both)
    table = np.sort(np.concatenate(blocks, axis=1), axis=1)
    new = np.ones(table.shape, bool)
    new[:, 1:] = table[:, 1:] != table[:, :-1]
    row, column = np.nonzero(new)
    return table[row, column], row


def _spread(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 4096):
            keys, row = keys_of(fps[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at : at + 4096][row])], ["key", "fp"])


def bucket_edges(fps: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Edges that connect what links of most_bits or fewer connect. Each step compares one member with those not yet reached only."""
    left, edges = fps.view(np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= most_bits
            queue += list(left[near])
            edges += [(at, x) for x in left[near]]
            left = left[~near]
    return edges


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Pairs of fingerprints that connect what links within the same key connect; keys are in order."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(starts, len(keys)))
    found = [np.empty((0, 2), np.int64)]
    small = np.repeat(size <= SMALL_BUCKET, size)
    for step in range(1, SMALL_BUCKET):
        i = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step])) if len(keys) > step else small[:0]
        if not len(i):
            break
        i = i[np.bitwise_count((fps[i] ^ fps[i + step]).view(np.uint64)) <= MOST_BITS]
        found.append(np.column_stack([fps[i], fps[i + step]]))
    for at, n in zip(starts[size > SMALL_BUCKET], size[size > SMALL_BUCKET]):
        if edges := bucket_edges(fps[at : at + n]):
            found.append(np.array(edges, np.uint64).view(np.int64))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def _verify(batches):
    """Links among the fingerprints of each key; the partition comes in order of keys, some of which are held at a time."""
    keys, fps, rows = [], [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy())
            rows += len(batch)
        if rows < VERIFY_ROWS and batch is not None or not rows:
            continue
        k, f = np.concatenate(keys), np.concatenate(fps)
        stop = len(k) if batch is None else int(np.searchsorted(k, k[-1]))
        if stop:
            pairs = bucket_links(k[:stop], f[:stop])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])
        keys, fps, rows = [k[stop:]], [f[stop:]], len(k) - stop


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of the column fp that connect all that are within 4 bits."""
    spread = fps.select("fp").mapInArrow(_spread, "key long, fp long")
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of 4 or fewer differing bits).

    Words are [^\\x20\\x09-\\x0D]+ after A-Z became a-z; shingles have 4 words, repeats included; texts of fewer words are
    one shingle; null texts and texts without words have fingerprint zero and are linked like others. Null ids take part
    and never name a component that has another id. Documents with one fingerprint are one node: copies cost nothing
    beyond their own rows. An empty table gives no rows.
    """
    marked = written(texts_of(docs, id_col, text_col).mapInArrow(_fingerprint, "doc_id long, fp long"), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    return named(marked, "fp", nodes, components(fingerprint_links(nodes))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their component of similar_documents (five-word shingles, near fingerprints or a band in common, similarity 0.8 or more), all columns, whatever their names; null ids that name none stay, a null text is empty. Ids name documents here: rows that share an id go together. An empty table stays empty."""
    from axonframe.llm.jaccard import similar_documents  # which takes its candidates from fingerprint_links

    name = fresh(docs, "drop")
    drop = similar_documents(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drop, docs[id_col].cast("long") == F.col(name), "left_anti")
