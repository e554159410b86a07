"""Repeated passages by prefix-partitioned suffix trees over words.

A window is `window` consecutive words; the suffixes that start windows form the trees. Each suffix is filed under a
prefix that equal windows share: the least-hashed run of PREFIX words inside its window (its anchor). Prefixes are
counted over the whole table first. One that occurs once has a single leaf below it, so none of its suffixes repeats and
none moves. One that occurs up to FREQUENT times is a memory-sized group. A more frequent one is lengthened to the whole
window: its suffixes are filed one by one under all their words.

A group's tree is built level by level from the words themselves (depths 1, 2, 4, ... window); only suffixes below an
internal node go deeper, and the nodes at full depth with two leaves or more are the repeats. Equal stretches are merged
where they are read, word by word, before they are shuffled, so that a passage that many documents share arrives once
per task or so, and no group grows with the number of documents.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import slices, split_words, texts_of, with_groups, written

WINDOW, PREFIX, FREQUENT = 35, 8, 4096
#: Bytes of stretches that a task remembers to merge later ones with; beyond it, it starts anew.
REMEMBERED_BYTES = 24 << 20
#: Windows in one run at most; a longer run is several.
RUN_WINDOWS = (1 << 24) - 1
ONE_SLICE = 2 << 20
#: Text of the stretches whose trees are grown at once.
GROUP_BYTES = 3 << 20
#: Odd multipliers of the rolling hashes, of bytes in a word and of words in a run.
BYTE_BASE, RUN_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.lru_cache(12)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i up to n."""
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _scale(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    room = 1 << max(16, int(n).bit_length())
    return _powers(base, room)[: n + 1], _powers(pow(base, -1, 1 << 64), room)[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


class Runs:
    """Hashes of any run of values in constant time, from sums of value times power."""

    def __init__(self, values: np.ndarray, base: int):
        powers, self.inverse = _scale(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


class Anchors:
    """The anchors of all windows of some texts: place in the words, hash, first window and number of windows of each, and its text."""

    def __init__(self, texts: pa.Array, window: int, prefix: int):
        self.words, self.first = split_words(texts)
        n = len(self.words)
        self.size = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(self.size)
        if n:
            begin = np.frombuffer(self.words.buffers()[1], np.int32)[self.words.offset]
            raw = np.frombuffer(self.words.buffers()[2], np.uint8)[begin : begin + ends[-1]]
        else:
            raw = np.empty(0, np.uint8)
        values = Runs(_BYTE_VALUES[raw], BYTE_BASE)(ends - self.size, ends)
        self.runs = Runs(values, RUN_BASE)
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        place = np.arange(n)
        left = self.first[doc + 1] - place if n else place
        hashes = np.full(n, NO_HASH)
        full = np.flatnonzero(left >= prefix)
        hashes[full] = self.runs(full, full + prefix)
        value, at, wide = hashes, place, 1
        reach = window - prefix + 1
        while wide < reach:
            step = min(wide, reach - wide)
            keep = value[:-step] <= value[step:]
            at = np.where(keep, at[:-step], at[step:])
            value = np.where(keep, value[:-step], value[step:])
            wide += step
        start = np.flatnonzero(left >= window)
        anchor = at[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        self.a = start[new]
        self.m = np.diff(np.append(np.flatnonzero(new), len(start)))
        self.hash = hashes[anchor[new]].view(np.int64)
        self.doc = doc[self.a] if n else self.a


def _count(window: int, prefix: int):
    def count(batches):
        for batch in batches:
            for part in slices(batch, most=ONE_SLICE):
                h, n = np.unique(Anchors(part.column(1), window, prefix).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return count


def _occurrences(window: int, prefix: int):
    """(h, row key) for each different anchor of each text."""

    def occur(batches):
        for batch in batches:
            for part in slices(batch, most=ONE_SLICE):
                found = Anchors(part.column(1), window, prefix)
                order = np.lexsort((found.hash, found.doc))
                h, doc = found.hash[order], found.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), part.column(0).take(pa.array(doc[new]))], ["h", "key"])

    return occur


def _squeeze(batches):
    """Texts as zstandard frames: they are shuffled twice, and this halves what is moved."""
    for batch in batches:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        frames = pa.array([squeeze(t.as_buffer()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), frames], ["doc_id", "mark", "frame"])


def _texts(frames: pa.Array) -> pa.Array:
    loosen = zstandard.ZstdDecompressor().decompress
    raw = [loosen(f.as_buffer()) for f in frames]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(raw)))


def _loosened(batches, column: str = "frame"):
    """Batches with texts in the frames' place, cut to slices."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + ONE_SLICE, side="right")))
            part = batch.slice(start, stop - start)
            start = stop
            yield from slices(part.set_column(at, "text", _texts(part.column(at))), most=ONE_SLICE)


STRETCH = "g long, doc_id long, mark long, a long, m long, words string"
RUN = "doc_id long, mark long, run long"


def pack_runs(a: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first window << 24 | number of windows) of runs of m windows from a, those of over RUN_WINDOWS windows in several pieces."""
    pieces = -(-m // RUN_WINDOWS)
    row = np.repeat(np.arange(len(m)), pieces)
    step = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN_WINDOWS
    return row, (a[row] + step << 24) | np.minimum(m[row] - step, RUN_WINDOWS)


def _joined(words: pa.Array, size: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Texts of the stretches of words, a space behind each word."""
    spaced = pc.binary_join_element_wise(words, "", " ")
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    base = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[base : base + ends[-1]]
    length = ends[stop] - ends[start]
    offsets = np.concatenate([[0], np.cumsum(length)])
    picked = data[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - ends[start], length)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(picked.tobytes()))


def alike(code: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words from a on equal those from b on, for `size` words."""
    same = np.ones(len(a), bool)
    for k in range(int(size.max(initial=0))):
        i = np.flatnonzero(same & (k < size))
        same[i] = code[a[i] + k] == code[b[i] + k]
    return same


def _stretches(window: int, prefix: int):
    """From (doc_id, mark, frame, prefixes, frequent): what goes to the trees.

    With words: a stretch whose windows share an ordinary prefix, or one window below a frequent prefix. Without words
    (null): windows known to repeat, since the same stretch was met before in this task.
    """

    def stretch(batches):
        seen: dict[str, list] = {}
        held = 0
        for part in _loosened(batches):
            if held > REMEMBERED_BYTES:
                seen, held = {}, 0
            held += yield from one_slice(part, seen)

    def one_slice(part, seen):
        found = Anchors(part.column(2), window, prefix)
        often = np.isin(found.hash, part.column(4).flatten().to_numpy())
        some = np.flatnonzero(np.isin(found.hash, part.column(3).flatten().to_numpy()) & ~often)
        many = np.repeat(np.flatnonzero(often), found.m[often])
        step = np.arange(len(many)) - np.repeat(np.cumsum(found.m[often]) - found.m[often], found.m[often])
        a = np.concatenate([found.a[some], found.a[many] + step])
        m = np.concatenate([found.m[some], np.ones(len(many), np.int64)])
        doc = np.concatenate([found.doc[some], found.doc[many]])
        if not len(a):
            return 0
        stop = a + m + window - 1
        whole = found.runs(a, stop).view(np.int64)
        g = np.concatenate([found.hash[some], whole[len(some) :]])
        local = a - found.first[doc]
        code = found.words.dictionary_encode().indices.to_numpy()
        _, rep, inverse = np.unique(whole, return_index=True, return_inverse=True)
        own = rep[inverse]
        other = np.flatnonzero((own != np.arange(len(own))) & (stop - a == (stop - a)[own]))
        other = other[alike(code, a[other], a[own[other]], (stop - a)[other])]
        settled = np.zeros(len(a), bool)
        settled[other] = settled[own[other]] = True
        ship = np.ones(len(a), bool)
        ship[other] = False
        first = np.flatnonzero(ship)
        texts = _joined(found.words, found.size, a[first], stop[first])
        ids, marks = part.column(0), part.column(1)
        back, held = [], 0
        id_of, mark_of = ids.to_pylist(), marks.to_pylist()
        for i, text in zip(first.tolist(), texts.to_pylist()):
            was = seen.get(text)
            if was is None:
                seen[text] = [id_of[doc[i]], mark_of[doc[i]], int(local[i]), int(m[i]), bool(settled[i])]
                held += len(text)
            else:
                ship[i], settled[i] = False, True
                if not was[4]:
                    was[4] = True
                    back.append(was)
        order = np.flatnonzero(settled)
        order = order[np.lexsort((local[order], doc[order]))]
        if len(order):
            d, s, n = doc[order], local[order], m[order]
            new = np.ones(len(order), bool)
            new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + n[:-1])
            at = np.flatnonzero(new)
            yield _rows(whole[order[at]], ids.take(pa.array(d[at])), marks.take(pa.array(d[at])), s[at], np.add.reduceat(n, at), None)
        if back:
            columns = list(zip(*back))
            yield _rows(np.arange(len(back)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), np.array(columns[2]), np.array(columns[3]), None)
        i = np.flatnonzero(ship)
        if len(i):
            yield _rows(g[i], ids.take(pa.array(doc[i])), marks.take(pa.array(doc[i])), local[i], m[i], texts.filter(pa.array(ship[first])))
        return held

    return stretch


def _rows(g, ids, marks, a, m, words):
    return pa.RecordBatch.from_arrays([pa.array(g), ids, marks, pa.array(a.astype(np.int64)), pa.array(m.astype(np.int64)), pa.nulls(len(g), pa.string()) if words is None else words], ["g", "doc_id", "mark", "a", "m", "words"])


def repeated_suffixes(code: np.ndarray, stop: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Which of the suffixes `start` share a node at depth `window` with another one.

    code: the words' numbers; stop: for each place, where its stretch ends. Level by level, a node of depth 2d is a pair
    of nodes of depth d; suffixes alone at a node are leaves and go no deeper.
    """
    node, depth = code.astype(np.int64), 1
    while depth < window:
        step = min(depth, window - depth)
        place = np.flatnonzero(np.arange(len(code)) + depth + step <= stop)
        place = place[(node[place] >= 0) & (node[place + step] >= 0)]
        pair = node[place] * (int(node.max(initial=0)) + 1) + node[place + step]
        _, name, count = np.unique(pair, return_inverse=True, return_counts=True)
        deeper = np.full(len(code), -1, np.int64)
        inner = count[name] > 1
        deeper[place[inner]] = name[inner]
        node, depth = deeper, depth + step
    return node[start] >= 0


def _trees(window: int):
    """(doc_id, mark, run) of repeated windows, runs as pack_runs gives them. Rows come in order of their prefixes: some groups are held at a time."""

    def grow(batches):
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                settled = pc.is_null(batch.column(5))
                if settled.true_count:
                    yield _emitted(batch.filter(settled))
                    batch = batch.filter(pc.invert(settled))
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column(5))).as_py() or 0
            if size < GROUP_BYTES and batch is not None or not held:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
            if not rows:
                continue
            rows = rows[0]
            g = rows.column(0).to_numpy()
            stop = len(g) if batch is None else int(np.flatnonzero(g != g[-1])[-1] + 1) if (g != g[-1]).any() else 0
            if stop:
                yield _group(rows.slice(0, stop))
            if stop < len(g):
                held = [rows.take(pa.array(np.arange(stop, len(g))))]

    def _group(rows):
        """Some prefixes' trees at once; a prefix is never split."""
        words, first = split_words(rows.column(5))
        code = words.dictionary_encode().indices.to_numpy()
        m = rows.column(4).to_numpy()
        row = np.repeat(np.arange(len(m)), m)
        step = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        again = repeated_suffixes(code, np.repeat(first[1:], np.diff(first)), first[row] + step, window)
        row, step = row[again], step[again]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
        at = np.flatnonzero(new)
        return _runs(rows, row[at], rows.column(3).to_numpy()[row[at]] + step[at], np.diff(np.append(at, len(row))))

    def _emitted(rows):
        return _runs(rows, np.arange(len(rows)), rows.column(3).to_numpy(), rows.column(4).to_numpy())

    def _runs(rows, row, a, m):
        piece, runs = pack_runs(a, m)
        own = pa.array(row[piece])
        return pa.RecordBatch.from_arrays([rows.column(1).take(own), rows.column(2).take(own), pa.array(runs)], ["doc_id", "mark", "run"])

    return grow


def repeated_runs(docs: DataFrame, frames: DataFrame, window: int = WINDOW, prefix: int = PREFIX, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, mark, run) of the windows of docs (doc_id, mark, text; frames has the texts squeezed) that start elsewhere too; run as in pack_runs. Rows that repeat bring their prefixes once; counts of very frequent prefixes go to their rows, which are dealt over all partitions."""
    counted = docs.select("doc_id", "text").mapInArrow(_count(window, prefix), "h long, n long")
    counts = written(counted.groupBy(F.col("h").alias("prefix")).agg(F.sum("n").alias("n")).where("n > 1"), "prefixes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    keyed = docs.select(F.xxhash64("doc_id", "mark").alias("key"), "text")
    occurring = keyed.mapInArrow(_occurrences(window, prefix), "h long, key long")
    found = with_groups(occurring, counts, {"h": "prefix"}, "n", total, "key").where(F.col("prefix").isNotNull())
    often = F.col("n") > frequent
    lists = found.groupBy(F.col("key").alias("of")).agg(F.collect_set(F.when(~often, F.col("prefix"))).alias("prefixes"), F.collect_set(F.when(often, F.col("prefix"))).alias("frequent"))
    held = frames.withColumn("key", F.xxhash64("doc_id", "mark")).join(lists, F.col("key") == F.col("of")).select("doc_id", "mark", "frame", "prefixes", "frequent")
    return held.mapInArrow(_stretches(window, prefix), STRETCH).repartition("g").sortWithinPartitions("g").mapInArrow(_trees(window), RUN)


def _cut(window: int):
    """Words that no run covers, joined by one space, with their number before and the number removed."""

    def cut(batches):
        for part in _loosened(batches):
            words, first = split_words(part.column(1))
            runs = part.column(2)
            lists = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = runs.flatten().to_numpy()
            start = (flat >> 24) + np.repeat(first[:-1], lists)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + (flat & RUN_WINDOWS) + window - 1, -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[first]
            left = words.filter(pa.array(keep))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), left), " ")
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - np.diff(kept)), texts], ["doc_id", "n_words", "n_removed", "kept_text"])

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (words that stay, joined by one space).

    Words are [^\\x20\\x09-\\x0D]+. Each word that is covered by a window of `window` words is removed if the window's
    words also start anywhere else, in the same document too; windows are judged on the input. Texts of fewer words, null
    and empty texts lose nothing. Repeated rows repeat each other. Rows are told apart by id (null is one) and text, which
    is enough: equal rows have equal results. An empty table gives no rows.
    """
    marked = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    frames = marked.mapInArrow(_squeeze, "doc_id long, mark long, frame binary")
    runs = repeated_runs(marked, frames, window, prefix, frequent)
    lists = runs.groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).agg(F.collect_set("run").alias("runs"))
    joined = frames.join(lists, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left")
    return joined.select("doc_id", "frame", "runs").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")


def removal_digest(docs: DataFrame, **options) -> DataFrame:
    """remove_repeats with the sha256 of kept_text in its place: doc_id, n_words, n_removed, kept_sha256 (of the empty text for a null or empty one). An empty table gives no rows."""
    return remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
