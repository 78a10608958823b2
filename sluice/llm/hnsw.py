"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, whose results are merged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, table, written

LINKS = 16  # to a node on upper layers; twice as many on the lowest
BUILD_BEAM = 64
SEARCH_BEAM = 128
SHARDS = 8
#: A shard, which is one row and one task, holds no more vectors and no more bytes of them (as doubles).
SHARD_VECTORS = 100_000
SHARD_BYTES = 1 << 28
#: Queries whose id more rows than this have are set against every vector, as a beam would have to pass all of those rows.
MOST_NAMESAKES = 512
QUERY_BLOCK = 512  # searched together
#: Queries of a group at most, and no more bytes of them than a shard has: about as large as a graph.
PART_QUERIES = 1 << 16
SEED = 7


# ---------------------------------------------------------------- graphs in flat arrays


@dataclass
class Layer:
    """nodes: places of the layer's vectors in the shard, by insertion; links: their neighbours (places in nodes), -1 where there are fewer."""

    nodes: np.ndarray
    links: np.ndarray


def _beam(vectors: np.ndarray, layer: Layer, size: int, queries: np.ndarray, entries: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The best width nodes that a beam search finds among the layer's first size nodes, for all queries together: places (-1: none) and similarities, best first."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    found = np.full((n, width), -1, np.int32)
    score = np.full((n, width), -np.inf, np.float32)
    k = min(entries.shape[1], width)
    found[:, :k] = entries[:, :k]
    score[:, :k] = np.where(entries[:, :k] >= 0, np.einsum("qkd,qd->qk", vectors[layer.nodes[entries[:, :k]]], queries), -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    found, score = found[rows, order], score[rows, order]
    done = np.zeros((n, width), bool)
    seen = np.zeros((n, size), bool)
    seen[np.broadcast_to(rows, found.shape)[found >= 0], found[found >= 0]] = True
    active = np.arange(n)
    while len(active):
        f, s, d = found[active], score[active], done[active]
        open_ = (f >= 0) & ~d
        rank = np.cumsum(open_, axis=1)
        take = open_ & (rank <= at_once)
        d |= take
        done[active] = d
        r, c = np.nonzero(take)
        near = layer.links[f[r, c]]
        qs = np.repeat(active[r], near.shape[1])
        flat = near.ravel()
        ok = flat >= 0
        qs, flat = qs[ok], flat[ok]
        new = ~seen[qs, flat]
        qs, flat = qs[new], flat[new]
        both = np.unique(qs.astype(np.int64) * size + flat)
        qs, flat = both // size, (both % size).astype(np.int32)
        seen[qs, flat] = True
        if len(qs):
            sim = np.einsum("nd,nd->n", vectors[layer.nodes[flat]], queries[qs])
            good = sim > score[qs, -1]
            qs, flat, sim = qs[good], flat[good], sim[good]
        if len(qs):
            starts = np.searchsorted(qs, active)
            counts = np.searchsorted(qs, active, "right") - starts
            most = int(counts.max())
            more = np.full((len(active), most), -1, np.int32)
            more_s = np.full((len(active), most), -np.inf, np.float32)
            row = np.repeat(np.arange(len(active)), counts)
            col = np.arange(len(qs)) - np.repeat(starts, counts)
            more[row, col], more_s[row, col] = flat, sim
            all_f, all_s = np.hstack([f, more]), np.hstack([s, more_s])
            all_d = np.hstack([d, np.zeros(more.shape, bool)])
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            at = np.arange(len(active))[:, None]
            found[active], score[active], done[active] = all_f[at, order], all_s[at, order], all_d[at, order]
        left = (found[active] >= 0) & ~done[active]
        active = active[left.any(axis=1)]
    return found, score


def _diverse(vectors: np.ndarray, nodes: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the row's own vector than to any chosen before; then the best of the rest, most in all."""
    n, width = found.shape
    v = vectors[nodes[np.maximum(found, 0)]]
    between = np.einsum("nad,nbd->nab", v, v)
    chosen = np.zeros((n, width), bool)
    closest = np.full((n, width), -np.inf, np.float32)
    for i in range(width):
        keep = (found[:, i] >= 0) & (closest[:, i] < score[:, i]) & (chosen.sum(1) < most)
        chosen[:, i] = keep
        closest = np.where(keep[:, None], np.maximum(closest, between[:, i, :]), closest)
    rank = np.where(found < 0, 3 * width, np.where(chosen, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(found, order, 1)


def _build_layer(vectors: np.ndarray, nodes: np.ndarray, links: int, upper: list[Layer], beam: int) -> Layer:
    """Insert nodes in batches that double up to a bound: each batch is searched in the graph of those before it and linked both ways."""
    layer = Layer(nodes, np.full((len(nodes), links), -1, np.int32))
    done = min(len(nodes), 2 * links)
    if done:
        sim = vectors[nodes[:done]] @ vectors[nodes[:done]].T
        np.fill_diagonal(sim, -np.inf)
        order = np.argsort(-sim, axis=1)[:, : min(links, done - 1)]
        layer.links[:done, : order.shape[1]] = order
    place = np.full(len(vectors), -1, np.int32)
    place[nodes] = np.arange(len(nodes))
    while done < len(nodes):
        take = min(len(nodes) - done, done, 1024)
        new = np.arange(done, done + take)
        queries = vectors[nodes[new]]
        entries = _entries(vectors, upper, queries, place, done)
        found, score = _beam(vectors, layer, done, queries, entries, beam)
        chosen = _diverse(vectors, nodes, found[:, :48], score[:, :48], links)
        layer.links[new] = -1
        layer.links[new, : chosen.shape[1]] = chosen
        # Back links: the nodes they go to choose again among their own and the new ones.
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, starts, counts = np.unique(dst, return_index=True, return_counts=True)
        most = min(int(counts.max()), 2 * links)
        extra = np.full((len(targets), most), -1, np.int32)
        col = np.arange(len(dst)) - np.repeat(starts, counts)
        row = np.repeat(np.arange(len(targets)), counts)
        extra[row[col < most], col[col < most]] = src[col < most]
        both = np.hstack([layer.links[targets], extra])
        for at in range(0, len(targets), 512):
            part, own = both[at : at + 512], vectors[nodes[targets[at : at + 512]]]
            sims = np.where(part >= 0, np.einsum("nkd,nd->nk", vectors[nodes[np.maximum(part, 0)]], own), -np.inf).astype(np.float32)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * links]
            part, sims = np.take_along_axis(part, order, 1), np.take_along_axis(sims, order, 1)
            layer.links[targets[at : at + 512]] = -1
            best = _diverse(vectors, nodes, part, sims, links)
            layer.links[targets[at : at + 512], : best.shape[1]] = best
        done += take
    return layer


def _entries(vectors: np.ndarray, upper: list[Layer], queries: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Places in a layer at which searches begin: what a descent through the layers above it finds, where inserted already, and the layer's first node."""
    at = np.zeros((len(queries), 1), np.int32)
    found = np.full((len(queries), 1), -1, np.int32)
    for i, layer in enumerate(upper):
        found, _ = _beam(vectors, layer, len(layer.nodes), queries, at, 8, 2)
        nodes = np.where(found >= 0, layer.nodes[np.maximum(found, 0)], -1)
        if i + 1 < len(upper):
            lower = np.full(len(vectors), -1, np.int32)
            lower[upper[i + 1].nodes] = np.arange(len(upper[i + 1].nodes))
            at = np.where(nodes >= 0, lower[np.maximum(nodes, 0)], -1)
        else:
            at = np.where(nodes >= 0, place[np.maximum(nodes, 0)], -1)
    if not upper:
        return at
    at = np.where(at < size, at, -1)
    first = np.where((at == 0).any(1, keepdims=True), -1, 0)
    return np.hstack([at, first]).astype(np.int32)


def build(vectors: np.ndarray, seed: int = SEED, links: int = LINKS, beam: int = BUILD_BEAM) -> list[Layer]:
    """Layers of a graph over vectors (rows of one length), from the top one, which fits in a beam, to the lowest, which has every row."""
    order = np.random.default_rng(seed).permutation(len(vectors)).astype(np.int32)
    sizes = [len(vectors)]
    while sizes[-1] > 4 * links:
        sizes.append(sizes[-1] // links)
    layers: list[Layer] = []
    for i, size in enumerate(reversed(sizes)):
        # An upper layer's nodes come first in the lower one, so searches can enter where they left.
        layers.append(_build_layer(vectors, order[:size], 2 * links if i == len(sizes) - 1 else links, layers, beam))
    return layers


def search(vectors: np.ndarray, layers: list[Layer], queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors (-1: none) and similarities of the k nearest found for each query."""
    place = np.full(len(vectors), -1, np.int32)
    place[layers[-1].nodes] = np.arange(len(vectors))
    entries = _entries(vectors, layers[:-1], queries, place, len(vectors))
    found, score = _beam(vectors, layers[-1], len(vectors), queries, entries, max(beam, k))
    found, score = found[:, :k], score[:, :k]
    return np.where(found >= 0, layers[-1].nodes[np.maximum(found, 0)], -1), score


# ---------------------------------------------------------------- over shards


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part: vectors of the commonest length without null or non-finite components, not all zero; ids not null."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (sizes.n if sizes else 0))


def _extended(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component that makes all of one length, so that nearness by inner product is nearness in space; of length 1, in single precision."""
    rest = np.sqrt(np.maximum(norm**2 - (v * v).sum(1), 0.0))
    return (np.hstack([v, rest[:, None]]) / norm).astype(np.float32)


@settled("nearest")
def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row where is_query (over id) holds, the k other rows found of largest inner product.

    Equal vectors are one node that knows its k + 1 smallest ids, as no more can be among anyone's k nearest, so a vector that
    very many rows share makes no crowd; ties go to the smaller id. Every shard (a hash of the vector; SHARDS, or more from SHARD_VECTORS or SHARD_BYTES each on)
    builds its graph in one task and stores it in the shared folder; blocks of distinct query vectors meet every graph there, and the best
    nodes of all shards are merged. Scores are inner products of the original vectors in double precision.
    A query meets every shard, so its rows with their vectors are queries times shards: the price of merging all shards' results.

    Rows that usable() leaves out take no part. Of repeated ids each row is its own; no row is a neighbour of one of its id, and such rows take nobody's
    place: nodes know k rows of an id and 2 k in all, beams widen by the rows of the query's id, and beyond MOST_NAMESAKES of them every vector is compared. An empty table gives none.
    """
    spark = vectors.sparkSession
    schema_out = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors, id_col, vector_col).withColumn("key", F.xxhash64("v")), "vectors")
    top = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m"), F.approx_count_distinct("key").alias("n"), F.max(F.size("v")).alias("width")).first()
    if top.m is None:
        return spark.createDataFrame([], schema_out)
    norm, shards = float(top.m) * (1 + 1e-9), max(SHARDS, -(-top.n // max(1, min(SHARD_VECTORS, SHARD_BYTES // (8 * top.width)))))
    namesakes = written(rows.groupBy("id").agg(F.count("*").alias("namesakes")).where("namesakes > 1"), "namesakes")
    repeated = not namesakes.isEmpty()
    room = 2 * k if repeated else k + 1
    members = rows
    if repeated:
        members = rows.withColumn("place", F.row_number().over(W.partitionBy("key", "v", "id").orderBy("id"))).where(F.col("place") <= k)
    members = members.withColumn("place", F.row_number().over(W.partitionBy("key", "v").orderBy("id"))).where(F.col("place") <= room)
    nodes = members.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    graph_schema = "shard int, ids array<array<long>>, vectors binary, width int, sizes array<int>, nodes binary, links array<binary>"

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        v = np.stack(group["v"].to_numpy()).astype(np.float64)
        layers = build(_extended(v, norm), beam=BUILD_BEAM)
        return pd.DataFrame([(int(group["shard"].iloc[0]), [list(x) for x in group["ids"]], v.tobytes(), v.shape[1], [len(x.nodes) for x in layers], layers[-1].nodes.tobytes(), [x.links.tobytes() for x in layers])], columns=[c.split()[0] for c in graph_schema.split(", ")])

    graphs = written(nodes.groupBy("shard").applyInPandas(make, graph_schema), "graphs")
    queries = rows.where(is_query).join(namesakes, "id", "left").groupBy("key", "v").agg(F.coalesce(F.max("namesakes"), F.lit(1)).alias("namesakes"))
    # Where one shard's queries are many, several copies of its graph share them.
    parts = -(-max(1, queries.count()) // max(1, min(PART_QUERIES, SHARD_BYTES // (8 * top.width))))
    blocks = queries.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def best_of(found: list[tuple[float, int]]) -> list[dict]:
        """The first room of found (less score, id), best first, with k of an id at most."""
        out, times = [], {}
        for less, i in sorted(found):
            times[i] = times.get(i, 0) + 1
            if times[i] <= k:
                out.append({"score": -less, "id": int(i)})
                if len(out) == room:
                    break
        return out

    def probe(key: tuple, asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "v", "near"]
        if not len(asked) or not len(graph):
            return pd.DataFrame(columns=columns)
        g = graph.iloc[0]
        v = np.frombuffer(g["vectors"], np.float64).reshape(-1, g["width"])
        order = np.frombuffer(g["nodes"], np.int32)
        layers = [Layer(order[:n], np.frombuffer(x, np.int32).reshape(n, -1)) for n, x in zip(g["sizes"], g["links"], strict=True)]
        q = np.stack(asked["v"].to_numpy()).astype(np.float64)
        lengthy, ids = _extended(v, norm), g["ids"]
        more, out = asked["namesakes"].to_numpy(), [None] * len(q)
        order = np.argsort(more, kind="stable")
        graph_only = order[more[order] <= MOST_NAMESAKES]
        for at in range(0, len(graph_only), QUERY_BLOCK):
            rows_ = graph_only[at : at + QUERY_BLOCK]
            part, wanted = q[rows_], k + int(more[rows_].max())
            flat = np.hstack([part, np.zeros((len(part), 1))]) / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-300)
            found, _ = search(lengthy, layers, flat.astype(np.float32), wanted, max(beam, 2 * wanted if wanted > k + 1 else 0))
            exact = np.einsum("qkd,qd->qk", v[np.maximum(found, 0)], part)
            for at_row, row, scores in zip(rows_, found, exact, strict=True):
                out[at_row] = best_of([(-s, i) for node, s in zip(row.tolist(), scores.tolist(), strict=True) if node >= 0 for i in ids[node]])
        for at_row in order[more[order] > MOST_NAMESAKES]:
            # Whole shard, best first, until room is full of rows of which no id has more than k.
            scores, entries, times = v @ q[at_row], [], {}
            for node in np.argsort(-scores, kind="stable").tolist():
                if len(entries) >= room and scores[node] < -entries[-1][0]:
                    break
                for i in ids[node]:
                    times[i] = times.get(i, 0) + 1
                    if times[i] <= k:
                        entries.append((-float(scores[node]), i))
            out[at_row] = best_of(entries)
        return pd.DataFrame({"key": asked["key"], "v": asked["v"], "near": out}, columns=columns)

    copies = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    near = blocks.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))
    near = near.applyInPandas(probe, "key long, v array<double>, near array<struct<score: double, id: long>>")
    best = near.groupBy("key", "v").agg(F.flatten(F.collect_list("near")).alias("near"))  # at most room from each shard
    by_score = lambda a, b: F.when(a.score != b.score, F.when(a.score > b.score, -1).otherwise(1)).otherwise(F.when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(0))
    best = best.withColumn("near", F.array_sort("near", by_score) if repeated else F.slice(F.array_sort("near", by_score), 1, room))
    asked = rows.where(is_query).select(F.col("id").alias("query_id"), "key", "v")
    lists = asked.join(best, ["key", "v"]).select("query_id", F.slice(F.filter("near", lambda x: x.id != F.col("query_id")), 1, k).alias("near"))
    return lists.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op9_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
