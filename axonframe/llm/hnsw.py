"""Near-duplicate embeddings: a navigable small-world graph per shard, every shard queried, cosines verified, links united.

Vectors of one label are dealt to shards of bounded size. A shard's graph is hierarchical: its points are in random
order and layer l holds the first n / 16 ** l of them, so that a search narrows from the top layer down. All queries of
a block are searched in step, one vectorised operation for each expansion. From the points of a query's beam that are
near enough, the search goes on along the graph's links, in both directions, as long as it meets such points, so that
dense groups are found whole. An audit compares some queries with all points; beams, and what is near enough, widen
until its recall is reached.

A shard's graph goes to one task, once; of two shards of a label one has its vectors searched in the other's graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import partitions, with_groups, written
from axonframe.llm.components import components

COSINE, SHARD, LINKS, BUILD_BEAM, BEAM, FAN = 0.98, 4096, 16, 32, 32, 16
#: How far below the least cosine a point may lie for the search to go on from it, at first.
MARGIN = 0.02
#: Queries that the audit compares with all points, as many where those have fewer than LINKS links, and the recall that it asks for.
AUDIT, WIDE_AUDIT, RECALL = 64, 512, 0.99
#: Where the audit still fails with beams of this width, the pair of shards is compared plainly.
WIDEST = 512
#: Pairs of queries and points that one step of the search goes on from.
FRONT = 1 << 16
BLOCK = 1024


def search(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `beam` points (and similarities, best first) found for each query from its entry points; -1 where there are fewer."""
    q, n = len(queries), len(graph)
    rows = np.arange(q)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    width = max(beam, entry.shape[1])
    ids = np.full((q, width), n, np.int64)
    ids[:, : entry.shape[1]] = np.where(entry < 0, n, entry)
    sims = np.full((q, width), -np.inf, np.float32)
    k = entry.shape[1]
    sims[:, :k] = np.einsum("qkd,qd->qk", vectors[np.minimum(ids[:, :k], n - 1)], queries)
    sims[:, :k][(ids[:, :k] == n) | _repeats(ids[:, :k])] = -np.inf
    seen[rows[:, None], ids] = True
    done = np.isneginf(sims)
    while True:
        open_sims = np.where(done, -np.inf, sims)
        at = open_sims.argmax(axis=1)
        live = np.flatnonzero(~done[rows, at])
        if not len(live):
            break
        done[live, at[live]] = True
        near = graph[ids[live, at[live]]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        got = np.einsum("qkd,qd->qk", vectors[np.minimum(near, n - 1)], queries[live])
        got[~fresh] = -np.inf
        all_sims = np.concatenate([sims[live], got], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), top, axis=1)
        sims[live] = np.take_along_axis(all_sims, top, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), top, axis=1) | np.isneginf(sims[live])
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(np.isneginf(sims), -1, ids), sims


def _repeats(ids: np.ndarray) -> np.ndarray:
    """Whether an entry stands earlier in its row."""
    order = np.argsort(ids, axis=1, kind="stable")
    line = np.take_along_axis(ids, order, axis=1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = line[:, 1:] == line[:, :-1]
    out = np.zeros(ids.shape, bool)
    np.put_along_axis(out, order, again, axis=1)
    return out


def select(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, links: int) -> np.ndarray:
    """`links` neighbours of each node among its candidates (-1: none): near ones first that are nearer to it than to those chosen, then the rest."""
    sims = np.einsum("qkd,qd->qk", vectors[np.maximum(candidates, 0)], vectors[nodes])
    sims[(candidates < 0) | (candidates == nodes[:, None]) | _repeats(candidates)] = -np.inf
    order = np.argsort(-sims, axis=1)
    candidates, sims = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(sims, order, axis=1)
    chosen = np.zeros(candidates.shape, bool)
    closest = np.full(candidates.shape, -np.inf, np.float32)
    for k in range(candidates.shape[1]):
        pick = (sims[:, k] > closest[:, k]) & (chosen.sum(axis=1) < links)
        chosen[:, k] = pick
        if k + 1 < candidates.shape[1] and pick.any():
            rest = np.einsum("qkd,qd->qk", vectors[np.maximum(candidates[pick, k + 1 :], 0)], vectors[np.maximum(candidates[pick, k], 0)])
            closest[pick, k + 1 :] = np.maximum(closest[pick, k + 1 :], rest)
    rank = np.where(np.isneginf(sims), 2, np.where(chosen, 0, 1))
    keep = np.argsort(rank, axis=1, kind="stable")[:, :links]
    out = np.where(np.take_along_axis(rank, keep, axis=1) == 2, -1, np.take_along_axis(candidates, keep, axis=1))
    return np.pad(out, ((0, 0), (0, max(0, links - out.shape[1]))), constant_values=-1).astype(np.int32)


def _layer(vectors: np.ndarray, upper: list[np.ndarray], n: int) -> np.ndarray:
    """The graph of the first n points; points join in doubling batches that search what is there and one another."""
    graph = np.full((n, LINKS), -1, np.int32)
    at = min(n, 2 * LINKS)
    everyone = np.arange(at)
    graph[:at] = select(vectors, everyone, np.tile(everyone, (at, 1)), LINKS)
    while at < n:
        more = np.arange(at, min(n, at + min(at, BLOCK)))
        found, _ = search(vectors[:at], graph[:at], vectors[more], descend(vectors, upper, vectors[more], at), BUILD_BEAM)
        fellows = np.argsort(-(vectors[more] @ vectors[more].T), axis=1)[:, : LINKS + 1] + at
        graph[more] = select(vectors, more, np.concatenate([found, fellows], axis=1), LINKS)
        source, target = np.repeat(more, LINKS), graph[more].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        close = place < 4 * LINKS
        back = np.full((len(nodes), min(int(count.max(initial=1)), 4 * LINKS)), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), count)[close], place[close]] = source[close]
        graph[nodes] = select(vectors, nodes, np.concatenate([graph[nodes], back], axis=1), LINKS)
        at += len(more)
    return graph


def descend(vectors: np.ndarray, upper: list[np.ndarray], queries: np.ndarray, n: int) -> np.ndarray:
    """Entry points (two for each query) to the layer below the given ones, from the top; all lie among the first n points."""
    entry = np.zeros((len(queries), 1), np.int64)
    for graph in upper:
        m = min(len(graph), n)
        own = np.where(graph[:m] < m, graph[:m], -1)
        entry = search(vectors[:m], own, queries, entry, 2)[0]
        entry[:, 0] = np.maximum(entry[:, 0], 0)
    return entry


def build(vectors: np.ndarray) -> list[np.ndarray]:
    """The layers' graphs, top first."""
    sizes = [len(vectors)]
    while sizes[-1] > 2 * FAN:
        sizes.append(-(-sizes[-1] // FAN))
    graphs: list[np.ndarray] = []
    for n in reversed(sizes):
        graphs.append(_layer(vectors, graphs, n))
    return graphs


def both_ways(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, to): the points linked with point i in either direction are to[start[i] : start[i + 1]]. A point that no link leads to is found from those it links to."""
    source, at = np.nonzero(graph >= 0)
    target = graph[source, at]
    a, to = np.concatenate([source, target]), np.concatenate([target, source])
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(len(graph) + 1)), to[order]


def onward(vectors: np.ndarray, ways: tuple[np.ndarray, np.ndarray], queries: np.ndarray, q: np.ndarray, p: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs given, of similarity `least` or more, and all such pairs that links reach from them over such points. ways: both_ways of the graph."""
    start, to = ways
    n = len(start) - 1
    seen = np.zeros((len(queries), n), bool)
    seen[q, p] = True
    found, fronts = [(q, p)], [(q, p)]
    while fronts:
        q, p = fronts.pop()
        if len(q) > FRONT:
            fronts.append((q[FRONT:], p[FRONT:]))
            q, p = q[:FRONT], p[:FRONT]
        size = start[p + 1] - start[p]
        q, p = np.repeat(q, size), to[np.arange(size.sum()) + np.repeat(start[p] - (np.cumsum(size) - size), size)]
        new = ~seen[q, p]
        pair = np.unique(q[new] * n + p[new])
        q, p = pair // n, pair % n
        seen[q, p] = True
        near = np.einsum("kd,kd->k", vectors[p], queries[q]) >= least
        if near.any():
            q, p = q[near], p[near]
            found.append((q, p))
            fronts.append((q, p))
    return np.concatenate([q for q, _ in found]), np.concatenate([p for _, p in found])


def audited(exact: np.ndarray, exact_queries: np.ndarray, cosine: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Queries that the audit looks at and which points each is linked to by plain comparison; own: the queries are the points, and none is a link of its own."""
    for most in (AUDIT, WIDE_AUDIT):
        rows = np.linspace(0, len(exact_queries) - 1, min(most, len(exact_queries))).astype(int)
        truth = exact_queries[rows] @ exact.T >= cosine
        if own:
            truth[np.arange(len(rows)), rows] = False
        if truth.sum() >= LINKS:
            break
    return rows, truth


def links(vectors: np.ndarray, graphs: list[np.ndarray], queries: np.ndarray, exact: np.ndarray, exact_queries: np.ndarray, cosine: float, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs of cosine or more that the graph gives. Beams and margin double until the audit's recall is reached, once in any case where the audit met no link. Should it not be reached with beams of WIDEST or all points, the last resort is plain comparison."""
    n = len(vectors)
    audit, truth = audited(exact, exact_queries, cosine, own)
    of = np.full(len(queries), -1)
    of[audit] = np.arange(len(audit))
    beam, margin, ways = BEAM, MARGIN, both_ways(graphs[-1])
    while True:
        pairs = [np.empty((0, 2), np.int64)]
        for at in range(0, len(queries), BLOCK):
            block = queries[at : at + BLOCK]
            found, sims = search(vectors, graphs[-1], block, descend(vectors, graphs[:-1], block, n), min(beam, n))
            r, c = np.nonzero((sims >= cosine - margin) & (found >= 0))
            q, p = onward(vectors, ways, block, r, found[r, c], cosine - margin)
            pairs.append(np.column_stack([q + at, p]))
        q, p = np.concatenate(pairs).T
        good = np.zeros(len(q), bool)
        for at in range(0, len(q), FRONT):
            i = slice(at, at + FRONT)
            good[i] = np.einsum("kd,kd->k", exact_queries[q[i]], exact[p[i]]) >= cosine
        q, p = q[good], p[good]
        hit = np.zeros(truth.shape, bool)
        some = of[q] >= 0
        hit[of[q[some]], p[some]] = True
        reached = (hit & truth).sum() >= RECALL * truth.sum()
        if reached and (truth.any() or beam > BEAM or beam >= n):
            return q, p
        if beam >= min(n, WIDEST):
            return plain_links(exact, exact_queries, cosine)
        beam, margin = 2 * beam, 2 * margin


def plain_links(exact: np.ndarray, exact_queries: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, point) pairs of cosine or more, without a graph."""
    pairs = [np.column_stack([r + at, c]) for at in range(0, len(exact_queries), 256) for r, c in [np.nonzero(exact_queries[at : at + 256] @ exact.T >= cosine)]]
    return tuple(np.concatenate(pairs).T)


def _unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    exact = raw.astype(np.float64)
    exact /= np.abs(exact).max(axis=1, keepdims=True)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    return exact.astype(np.float32), exact


SHARDS = "label string, dim int, shard int, shards int, ids binary, copies binary, vectors binary, graphs array<binary>"


def _indexer(exact: bool):
    """A shard's row: its classes in an order that their ids' hash gives, and its graphs (none where links are found plainly)."""

    def index(pdf):
        import pandas as pd

        pdf = pdf.iloc[np.argsort((pdf["id"].to_numpy(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))]
        raw = np.array(pdf["vector"].tolist(), np.float64)
        graphs = [] if exact else [g.tobytes() for g in build(_unit(raw)[0])]
        head = pdf.iloc[0]
        return pd.DataFrame([[head["label"], head["dim"], head["shard"], head["shards"], pdf["id"].to_numpy(np.int64).tobytes(), pdf["copies"].to_numpy(np.int64).tobytes(), raw.tobytes(), graphs]], columns=["label", "dim", "shard", "shards", "ids", "copies", "vectors", "graphs"])

    return index


def _compare(cosine: float, exact_links: bool):
    """Rows come in order, each shard's own row (with its graphs) first, then those of the shards that are searched in it. For each such pair: how many vectors each class is linked to, and edges that connect linked classes."""

    def compare(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                other = np.frombuffer(row["ids"], np.int64)
                other_copies = np.frombuffer(row["copies"], np.int64)
                q_near, q_exact = _unit(np.frombuffer(row["vectors"]).reshape(len(other), -1))
                own = row["j"] < 0
                if own:
                    ids, copies, near, exact = other, other_copies, q_near, q_exact
                    graphs = [np.frombuffer(g, np.int32).reshape(-1, LINKS) for g in row["graphs"]]
                q, p = plain_links(exact, q_exact, cosine) if exact_links else links(near, graphs, q_near, exact, q_exact, cosine, own)
                if own:
                    q, p = np.minimum(q, p), np.maximum(q, p)
                    pair = np.unique((q * len(ids) + p)[q != p])
                    a, b = pair // len(ids), pair % len(ids)
                    all_ids, all_copies = ids, copies
                else:
                    a, b = q + len(ids), p
                    all_ids, all_copies = np.concatenate([ids, other]), np.concatenate([copies, other_copies])
                n = np.bincount(a, all_copies[b], len(all_ids)) + np.bincount(b, all_copies[a], len(all_ids))
                least, before = np.arange(len(all_ids)), None
                while before is None or (least != before).any():
                    before = least.copy()
                    np.minimum.at(least, a, least[b])
                    np.minimum.at(least, b, least[a])
                    least = least[least]
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(all_ids[some]), pa.array(all_ids[least[some]]), pa.array(n[some].astype(np.int64))], ["id", "to", "n"])

    return compare


def linked_classes(classes: DataFrame, cosine: float = COSINE, shard: int = SHARD, exact: bool = False) -> DataFrame:
    """(id, to, n): per pair of shards and class with links there, a class it is connected to and the vectors it is linked to. classes: id, label, dim, vector, copies."""
    spark = classes.sparkSession
    sizes = classes.groupBy(F.col("label").alias("of_label"), F.col("dim").alias("of_dim")).agg(F.count(F.lit(1)).alias("size")).withColumn("shards", F.ceil(F.col("size") / shard).cast("int"))
    dealt = with_groups(classes, sizes, {"label": "of_label", "dim": "of_dim"}, "size", classes.count(), "id").withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int"))
    indexed = written(dealt.select("id", "label", "dim", "vector", "copies", "shards", "shard").groupBy("label", "dim", "shard").applyInPandas(_indexer(exact), SHARDS), "shards")
    of_two = F.when((F.abs(F.col("i") - F.col("j")) % 2) == 1, F.least("i", "j")).otherwise(F.greatest("i", "j"))
    graphs = indexed.select("label", "dim", F.col("shard").alias("i"), F.lit(-1).alias("j"), "ids", "copies", "vectors", "graphs")
    asked = indexed.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("i"), F.col("shard").alias("j"), "ids", "copies", "vectors").where((F.col("i") != F.col("j")) & (of_two == F.col("i")))
    rows = graphs.unionByName(asked, allowMissingColumns=True).repartition(partitions(spark), "label", "dim", "i").sortWithinPartitions("label", "dim", "i", "j")
    return rows.mapInArrow(_compare(cosine, exact), "id long, to long, n long")


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = COSINE, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", exact: bool = False) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Vectors are compared where labels are equal and not null and lengths are equal. A vector that is null, empty, zero or
    has a null or non-finite component is linked with nothing and is its own component. Equal vectors of one label are one
    node: they are linked with one another and with what it is linked with, without being expanded into pairs. Null ids
    take part and name no component that has another id. An empty table gives no rows. Pairs are found by the graphs, at
    the audits' recall or more; exact=True compares the same pairs of shards plainly instead and misses none.
    """
    vector = F.col("vector")
    rows = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[label_col].cast("string").alias("label"), embeddings[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & finite, F.lit(False)))
    classes = rows.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "label", F.size("vector").alias("dim"), "vector", "least", "copies"), "classes")
    found = written(linked_classes(classes.drop("least"), cosine, shard, exact), "links")
    counts = found.groupBy(F.col("id").alias("of")).agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    placed = classes.join(counts, F.col("id") == F.col("of"), "left").join(roots, F.col("id") == F.col("node"), "left")
    placed = written(placed.select("id", "label", "vector", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("root")), "placed")
    total, vectors = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    names = placed.groupBy(F.col("root").alias("name")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = with_groups(placed, names, {"root": "name"}, "members", total, "id").select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), "copies", "n_links", "component_id")
    linked = with_groups(rows.where("ok"), named, {"label": "of_label", "vector": "of_vector"}, "copies", vectors, "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
