"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands name candidates, whole shingle sets decide.

A set's fingerprint has the bits that are set in over half of its hashes. Fingerprints at 4 or fewer differing bits meet
by the Golay-code keys of simhash.fingerprint_links, and what these connect is a bucket. Most pairs near LEAST differ in
more bits than such keys can bridge; for them there are bands as well.

A band is the least values of ROWS hash functions over a text's set; two sets of similarity s agree in a band with
probability s ** ROWS, and those that do share the band's bucket. Only pairs of similarity LEAST or more, counted on the
whole sets, are links. A pair at 0.8 meets in none of the 50 bands with probability 3e-7, one at 0.85 with 6e-11.

Buckets are verified, never united unverified. First each set is compared with the least set of each of its buckets, each
such pair once: that settles buckets of two, and groups of near copies, whose buckets share their least sets. A bucket
that still holds several components is open: sets outside its largest one are compared with all of other components.
Buckets with the same sets are opened once. No group of sets that one task compares has more than BLOCK sets, or ENTRIES
hashes and one set, on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import removed, slices, split_words, texts_of, with_groups, written
from axonframe.llm.components import components, named
from axonframe.llm.simhash import fingerprint_links, majorities

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS = 50, 6
#: Sets, and hashes of sets, that a task compares on either side.
BLOCK, ENTRIES = 1024, 1 << 21
#: Hashes of all sets for each set asked about, above which one looks at these alone.
ONE_BY_ONE = 400

_rng = np.random.default_rng(SEED)
_ODD = _rng.integers(0, 1 << 63, SHINGLE + BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sets_of(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles, those of one text ascending, and each text's first place (one more at the end). A text of fewer words is one shingle."""
    words, first = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = np.concatenate([known[coded.indices.to_numpy()], np.zeros(shingle, np.uint64)])
    n = np.diff(first)
    count = np.maximum(n - shingle + 1, 1)
    doc = np.repeat(np.arange(len(n)), count)
    i = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    left = first[doc + 1] - i
    hashes = np.zeros(len(doc), np.uint64)
    for k in range(shingle):
        hashes += np.where(k < left, word[np.minimum(i + k, len(word) - 1)] * _ODD[k], np.uint64(0))
    hashes = _mixed(hashes)
    order = np.lexsort([hashes, doc])
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(n) + 1))


def names_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set, 128 bits together, the same for equal sets."""
    return tuple(_mixed(np.add.reduceat(_mixed(hashes ^ seed), first[:-1]) + np.diff(first).astype(np.uint64)).view(np.int64) for seed in (_ODD[0], _ODD[1]))


def bands_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS keys for each set, one column for each band."""
    out = np.empty((len(first) - 1, BANDS), np.uint64)
    work = np.empty_like(hashes)
    for band in range(BANDS):
        key = np.full(len(out), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(hashes, _MASK[k], out=work)
            np.multiply(work, _ODD[SHINGLE + k], out=work)
            key = _mixed(key ^ np.minimum.reduceat(work, first[:-1]))
        out[:, band] = key
    return out.view(np.int64)


def _sketch(batches):
    for batch in batches:
        for part in slices(batch, most=1 << 20):
            hashes, first = sets_of(part.column(3))
            bands = bands_of(hashes, first)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, names_of(hashes, first)), pa.array(np.diff(first)), pa.array(majorities(hashes, first).view(np.int64)), listed], ["row", "doc_id", "t", "n1", "n2", "len", "fp", "bands"])


def _sets(batches):
    for batch in batches:
        for part in slices(batch, most=1 << 20):
            hashes, first = sets_of(part.column(0))
            yield pa.RecordBatch.from_arrays([*map(pa.array, names_of(hashes, first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["n1", "n2", "hashes"])


def _shared(mark: np.ndarray, hashes: np.ndarray, first: np.ndarray, some: np.ndarray) -> np.ndarray:
    """How many marked hashes each of some sets has: counted over all sets at once where these are short, set by set elsewhere."""
    if len(hashes) < ONE_BY_ONE * len(some):
        return np.add.reduceat(mark[hashes], first[:-1], dtype=np.int64)[some]
    return np.fromiter((np.count_nonzero(mark[hashes[first[x] : first[x + 1]]]) for x in some.tolist()), np.int64, len(some))


def _numpy(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = table["hashes"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    first = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[first[0] : first[-1]], first - first[0]


def star_edges(hashes: np.ndarray, first: np.ndarray, hub: int, least: float = LEAST) -> np.ndarray:
    """The sets other than the hub that are linked to it."""
    size, mine = np.diff(first), np.sort(hashes[first[hub] : first[hub + 1]])
    there = mine[np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)] == hashes
    both = np.add.reduceat(there, first[:-1], dtype=np.int64)
    linked = both >= least * (size + size[hub] - both)
    linked[hub] = False
    return np.flatnonzero(linked)


def _star(table: pa.Table) -> pa.Table:
    nodes, hub = table["node"].to_numpy(), table["hub"].to_numpy()
    found = star_edges(*_numpy(table), int(np.flatnonzero(nodes == hub)[0]))
    return pa.table({"a": nodes[found], "b": hub[found]})


def cross_edges(hashes: np.ndarray, first: np.ndarray, root: np.ndarray, asks: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Links between the sets that ask and all sets, one for each two roots that are linked."""
    _, hashes = np.unique(hashes, return_inverse=True)
    size = np.diff(first)
    mark = np.zeros(int(hashes.max()) + 1 if len(hashes) else 0, bool)
    known, edges = {}, []
    for at in np.flatnonzero(asks).tolist():
        mine = hashes[first[at] : first[at + 1]]
        mark[mine] = True
        some = np.flatnonzero((root != root[at]) & (np.minimum(size, size[at]) >= least * np.maximum(size, size[at])))
        done = known.setdefault(root[at], {root[at]})
        both = _shared(mark, hashes, first, some)
        for x in some[both >= least * (size[some] + size[at] - both)].tolist():
            if root[x] not in done:
                edges.append((at, x))
                done.add(root[x])
        mark[mine] = False
    return edges


def _cross(table: pa.Table) -> pa.Table:
    nodes = table["node"].to_numpy()
    edges = np.array(cross_edges(*_numpy(table), table["root"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)), np.int64).reshape(-1, 2)
    return pa.table({"a": nodes[edges[:, 0]], "b": nodes[edges[:, 1]]})


def _block(node: str, salt: int, blocks):
    return F.pmod(F.xxhash64(F.lit(salt), node), blocks).cast("int")


def _blocks(n, entries, block: int):
    """How many blocks n sets of so many hashes make."""
    return F.greatest(F.ceil(n / F.lit(block)), F.ceil(entries / F.lit(ENTRIES)), F.lit(1)).cast("int")


def star_links(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between sets and the hubs (least sets) of their buckets. members: node, hub, len; sets: node, hashes."""
    pairs = written(members.where("node <> hub").select("hub", "node", "len").distinct(), "pairs")
    stats = pairs.groupBy(F.col("hub").alias("of_hub")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("entries"))
    stats = written(stats.select("of_hub", "n", _blocks(F.col("n"), F.col("entries"), block).alias("blocks")), "hubs")
    dealt = with_groups(pairs, stats, {"hub": "of_hub"}, "n", pairs.count(), "node").select("hub", _block("node", 0, F.col("blocks")).alias("block"), "node")
    hubs = stats.select(F.col("of_hub").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("of_hub").alias("node"))
    held = sets.select(F.col("node").alias("of"), "hashes")
    return dealt.union(hubs).join(held, F.col("node") == F.col("of")).select("hub", "block", "node", "hashes").groupBy("hub", "block").applyInArrow(_star, "a long, b long")


def open_buckets(members: DataFrame, settled: DataFrame) -> DataFrame:
    """(key, node, len, root) of the buckets that hold several components, one of those with the same sets. A bucket of two has been compared already."""
    found = settled.withColumnRenamed("node", "of")
    placed = members.select("key", "node", "len").join(found, F.col("node") == F.col("of"), "left").select("key", "node", "len", F.coalesce("component", "node").alias("root"))
    sides = [F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"x{salt}") for salt in (1, 2)]
    kinds = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *sides).where("n > 2 AND low <> high")
    keys = written(kinds.groupBy("n", "x1", "x2").agg(F.min("key").alias("open_key")).select("open_key"), "open")
    return placed.join(keys, F.col("key") == F.col("open_key")).select("key", "node", "len", "root")


def open_links(rows: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between sets of different components within a bucket, one or more for each two components that are linked. rows: as open_buckets gives them."""
    roots = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("len").alias("hashes_of"))
    most = F.max(F.struct("size", "root", "hashes_of"))
    tops = roots.groupBy(F.col("key").alias("of_key")).agg(most.alias("top"), F.sum("size").alias("all"), F.sum("hashes_of").alias("entries"))
    left = (F.col("all") - F.col("top.size"), F.col("entries") - F.col("top.hashes_of"))
    tops = written(tops.select("of_key", F.col("top.root").alias("top"), "all", _blocks(*left, block).alias("lefts"), _blocks(F.col("all"), F.col("entries"), block).alias("alls")), "tops")
    dealt = with_groups(rows, tops, {"key": "of_key"}, "all", rows.count(), "node").select("key", "node", "root", "top", "lefts", "alls")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = dealt.where("root <> top").select("key", _block("node", 3, F.col("lefts")).alias("i"), upto(F.col("alls")).alias("j"), "node", "root", F.lit(True).alias("asks"))
    asked = dealt.select("key", upto(F.col("lefts")).alias("i"), _block("node", 4, F.col("alls")).alias("j"), "node", "root", F.lit(False).alias("asks"))
    held = sets.select(F.col("node").alias("of"), "hashes")
    rows = asking.union(asked).join(held, F.col("node") == F.col("of")).select("key", "i", "j", "node", "root", "asks", "hashes")
    return rows.groupBy("key", "i", "j").applyInArrow(_cross, "a long, b long")


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """(near, kin) for each fingerprint of the column fp that its Golay-code keys connect with another, at 4 or fewer bits each time, or that several rows have: kin is the same for all that are connected."""
    alike = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    alike = written(alike, "fingerprints")
    kin = components(fingerprint_links(alike)).select(F.col("node").alias("near"), F.col("component").alias("kin"))
    found = alike.join(kin, F.col("fp") == F.col("near"), "left").where("near IS NOT NULL OR n > 1")
    return found.select(F.col("fp").alias("near"), F.coalesce("kin", "fp").alias("kin"), "n")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: doc_id, component_id (least doc_id reachable over links of similarity LEAST or more of the sets of five-word shingles).

    Words are [^\\x20\\x09-\\x0D]+ after A-Z became a-z; texts of fewer words are one shingle; null texts and texts
    without words are equal. Null ids take part and never name a component that has another id. Texts of one set are
    one node: copies cost nothing beyond their own rows. A set is known by 128 bits, a shingle by 64. An empty table
    gives no rows; other columns are ignored, whatever their names. bands: so many of the BANDS name candidates beside the
    fingerprints.
    """
    texts = texts_of(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("t"), "text")
    sketched = written(texts.mapInArrow(_sketch, "row long, doc_id long, t long, n1 long, n2 long, len long, fp long, bands array<long>"), "sketches")
    nodes = sketched.groupBy(F.col("n1").alias("s1"), F.col("n2").alias("s2")).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    firsts = written(sketched.join(nodes.select("node"), F.col("row") == F.col("node")).select("node", "len", "t", "fp", F.slice("bands", 1, bands).alias("bands")), "firsts")
    # A bucket of near fingerprints is named apart from those of bands, by another hash of 64 bits.
    kin = with_groups(firsts.select("node", "len", "t", "fp"), near_fingerprints(firsts.select("fp")), {"fp": "near"}, "n", firsts.count(), "node").where("kin IS NOT NULL")
    banded = firsts.select("node", "len", "t", F.explode("bands").alias("key")).union(kin.select("node", "len", "t", F.xxhash64(F.lit("fingerprints"), "kin")))
    banded = written(banded, "bands")
    removed(firsts)
    met = banded.groupBy(F.col("key").alias("met")).agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    met = written(met.select("met", "hub"), "met")
    members = written(banded.join(met, F.col("key") == F.col("met")).select("key", "node", "len", "t", "hub"), "members")
    removed(banded)
    # The texts of the members again, found by their hash; a text that only shares the hash has another name and falls away.
    wanted = written(members.select(F.col("t").alias("of_t"), "node").distinct(), "wanted")
    again = texts.select("t", "text").join(wanted.select("of_t").distinct(), F.col("t") == F.col("of_t"), "left_semi").select("text").mapInArrow(_sets, "n1 long, n2 long, hashes array<long>")
    named_sets = again.join(nodes.join(wanted.select(F.col("node").alias("some")), F.col("node") == F.col("some"), "left_semi"), (F.col("n1") == F.col("s1")) & (F.col("n2") == F.col("s2")))
    sets = written(named_sets.select("node", "hashes").dropDuplicates(["node"]), "sets")
    links = written(star_links(members, sets, block), "links")
    settled = components(links)
    open_rows = written(open_buckets(members, settled), "open-rows")
    if not open_rows.isEmpty():
        more = written(open_links(open_rows, sets, block), "links")
        if not more.isEmpty():
            settled = components(links.union(more))
    for table in (members, sets, wanted, met, open_rows):
        removed(table)
    marked = sketched.select("doc_id", "n1", "n2")
    copies = nodes.select(F.col("s1").alias("of_1"), F.col("s2").alias("of_2"), F.col("node").alias("of_node"), F.col("copies").alias("rows_of"))
    placed = with_groups(marked, copies, {"n1": "of_1", "n2": "of_2"}, "rows_of", marked.count(), "doc_id").select("doc_id", "of_node")
    return named(placed, "of_node", nodes.select(F.col("node").alias("of_node"), "least", "copies"), settled).select("doc_id", "component_id")
