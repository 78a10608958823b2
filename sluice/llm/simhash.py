"""Near-duplicate documents by SimHash, searched with a generalised pigeonhole filter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_pairs, connected_components, settled, table, unused, written

#: Row b holds bit i of byte b in byte i of a long: up to 255 rows add up without a carry between bits.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
BLOCK = 255 * 128
#: Rows of a bucket up to which every pair of it is checked.
BUCKET = 16
#: Slots, by their hashes, of a text's shingles.
SLOTS = 1024


# ---------------------------------------------------------------- fingerprints


def words_of_text(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Every run of width words, repeats included; fewer words are one shingle, none gives none."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    return [line[a:b] for a, b in zip([0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist(), strict=True)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        lanes = SPREAD[hashes[at : at + BLOCK].view(np.uint8)].reshape(-1, 8)
        lanes = np.concatenate([lanes, np.zeros((-len(lanes) % 255, 8), np.uint64)]).reshape(-1, 255, 8)
        total += np.ascontiguousarray(lanes.sum(1, dtype=np.uint64)).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bit is 1 where over half the hashes have it; 0 for none."""
    if not len(hashes):
        return 0
    ones = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def _remix(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """hashes, then n - 1 further hash functions of them (a multiply and xor-shift finaliser for each)."""
    out = [hashes]
    for k in range(1, n):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return out


def fingerprints(docs: DataFrame, width: int = 3, longs: int = 1, distinct: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of docs plus f0..f{longs-1}, the 64-bit SimHashes of its text's word shingles (XXH64, seed 42).

    distinct counts each shingle once. Whole texts are taken, in blocks, so memory follows the longest text only.
    """
    fields = [docs.schema[k] for k in keep] + [T.StructField(f"f{i}", T.LongType()) for i in range(longs)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found = np.zeros((len(batch), longs), np.int64)
            for i, text in enumerate(batch["text"]):
                grams = shingles(words_of_text(text), width)
                grams = set(grams) if distinct else grams
                hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams))
                found[i] = [fingerprint(h) for h in _remix(hashes, longs)]
            out = batch[list(keep)].copy()
            for i in range(longs):
                out[f"f{i}"] = found[:, i]
            yield out

    return docs.select(*keep, "text").mapInPandas(run, T.StructType(fields))


# ---------------------------------------------------------------- the filter's plan


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int  # of differing bits; -1: unused


def bit_statistics(prints: DataFrame, longs: int) -> tuple[int, np.ndarray]:
    """Rows of prints, and how many have both bit i and bit j of the same long: fixed-size matrices, summed over all rows."""
    n = 64 * longs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, rows = np.zeros((n, 64)), 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = np.ascontiguousarray(batch.iloc[at : at + 4096].to_numpy(np.int64))
                bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                for k in range(0, n, 64):
                    both[k : k + 64] += bits[:, k : k + 64].T @ bits[:, k : k + 64]
                rows += len(part)
        yield pd.DataFrame({"i": [*range(n), n], "with_j": [*both, np.array([float(rows)])]})

    sums = prints.select(*[f"f{i}" for i in range(longs)]).mapInPandas(run, "i int, with_j array<double>")
    sums = sums.select("i", F.posexplode("with_j").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("row")).collect()
    matrix, rows = np.zeros((n, n)), 0
    for r in sums:
        if r.i == n:
            rows = int(r.row[0].x)
        else:
            matrix[r.i, r.i // 64 * 64 : r.i // 64 * 64 + 64] = [x.x for x in r.row]
    return rows, matrix


def _ordered(rows: int, both: np.ndarray) -> list[int]:
    """Bits in a chain in which each follows the one it is most correlated with, so that a cut groups them."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    corr[(both == 0) | np.eye(len(p), dtype=bool)] = 0
    chain, left = [int(corr.sum(1).argmax())], set(range(len(p)))
    left.discard(chain[0])
    while left:
        chain.append(max(sorted(left), key=lambda b: corr[chain[-1], b]))
        left.discard(chain[-1])
    return chain


def _near(bits: list[int], p: np.ndarray, joint: np.ndarray, most: int) -> list[float]:
    """Estimated chance that two rows differ in at most 0..most of the bits: independent bits, then a factor for neighbours that agree together."""
    at = np.zeros(most + 1)
    at[0] = 1.0
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        at[1:] = at[1:] * (1 - q) + at[:-1] * q
        at[0] *= 1 - q
    factor = 1.0
    for a, b in zip(bits, bits[1:], strict=False):
        one = [p[a] - joint[a, b], p[b] - joint[a, b], joint[a, b], 1 - p[a] - p[b] + joint[a, b]]
        agree = sum(x * x for x in one)
        alone = (1 - 2 * p[a] * (1 - p[a])) * (1 - 2 * p[b] * (1 - p[b]))
        factor *= max(agree, 1e-12) / max(alone, 1e-12)
    return np.minimum(1.0, np.cumsum(at) * max(1.0, factor)).tolist()


def keys_of(threshold: int, bits: int) -> int:
    """Keys that a row is listed under: none, its own, or its own and all at one bit from it."""
    return 0 if threshold < 0 else 1 if threshold == 0 else bits + 1


def plan(rows: int, both: np.ndarray, distance: int, counts: range, most: int = 2, per_key: float = 8.0) -> list[Partition]:
    """Partitions of correlated bits and their thresholds, at the least estimated cost.

    Two fingerprints within distance differ, in one partition at least, by no more than its threshold, if the
    thresholds add up to distance - partitions + 1 (general pigeonhole principle). For each number of
    partitions, dynamic programming over (partition, sum so far) finds the thresholds of least cost:
    estimated candidates, plus per_key for each key that a row is listed under.
    """
    chain, p, joint = _ordered(rows, both), np.diag(both) / max(rows, 1), both / max(rows, 1)
    best: tuple[float, list[Partition]] = (math.inf, [])
    for m in counts:
        groups = [[int(b) for b in g] for g in np.array_split(chain, m)]
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for g in groups:
            near, step = _near(g, p, joint, most), {}
            for total, (cost, chosen) in states.items():
                for t in range(-1, most + 1):
                    new = cost + rows * per_key * keys_of(t, len(g)) + (rows * rows / 2 * near[t] if t >= 0 else 0.0)
                    if new < step.get(total + t, (math.inf,))[0]:
                        step[total + t] = (new, (*chosen, t))
            states = step
        cost, chosen = states.get(distance - m + 1, (math.inf, ()))
        if cost < best[0]:
            best = cost, [Partition(tuple(g), t) for g, t in zip(groups, chosen, strict=True)]
    if not best[1]:
        raise ValueError("no allocation of thresholds reaches that distance")
    return best[1]


def signatures(prints: DataFrame, parts: list[Partition], probing: bool, *columns: str) -> DataFrame:
    """columns (longs), key and own: a row for each key of each row of prints, the partition's number above its bits. Indexed rows stand under their own key
    and, at a threshold of 2, those one bit from it; probing rows also under those at a threshold of 1. own tells a row's own key."""
    used = [(number, p) for number, p in enumerate(parts) if p.threshold >= 0]
    longs = sorted({b // 64 for _, p in used for b in p.bits} | {0})
    fields = list(dict.fromkeys([*columns, *(f"f{i}" for i in longs)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                words = {i: part[f"f{i}"].to_numpy(np.int64).view(np.uint64) for i in longs}
                rows, keys, owns = [], [], []
                for number, p in used:
                    own = np.full(len(part), number << 40, np.uint64)
                    for i, b in enumerate(p.bits):
                        own |= ((words[b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(i)
                    wide = p.threshold == 2 or (p.threshold == 1 and probing)
                    for mask in [0, *(1 << i for i in range(len(p.bits)))] if wide else [0]:
                        rows.append(np.arange(len(part)))
                        keys.append(own ^ np.uint64(mask))
                        owns.append(np.full(len(part), mask == 0))
                out = part[list(columns)].iloc[np.concatenate(rows)]
                yield out.assign(key=np.concatenate(keys).view(np.int64), own=np.concatenate(owns))

    schema = ", ".join([*(f"{c} long" for c in columns), "key long", "own boolean"])
    return prints.select(*fields).mapInPandas(run, schema)


# ---------------------------------------------------------------- links between fingerprints


def links_within(prints: DataFrame, distance: int, bucket: int = 64) -> DataFrame:
    """Edges (a, b) that connect exactly what links of distance (0 to 2) or fewer bits connect among the distinct longs f0.

    Keys that more than bucket rows stand under are not joined pair by pair. Their rows are linked through
    the 65 longs at no more than one bit from each: two longs differ by two bits at most if and only if they share
    such a point, so linking each to the least row at each of its points keeps every link, with 65 rows for each.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    rows, both = bit_statistics(prints, 1)
    if rows < 2:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    parts = plan(rows, both, distance, range(2, 5) if distance else range(1, 3))
    index, probe = signatures(prints, parts, False, "f0").drop("own"), signatures(prints, parts, True, "f0").drop("own")
    crowded = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key")
    a, b = probe.join(crowded, "key", "left_anti").select("key", F.col("f0").alias("a")), index.select("key", F.col("f0").alias("b"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & differ).select("a", "b")
    hot = probe.join(crowded, "key", "left_semi").select("f0").distinct()
    masks = F.array(*(F.lit(m).cast("long") for m in [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(64))])) if distance == 2 else F.array(F.lit(0).cast("long"))
    points = hot.select("f0", F.explode(F.transform(masks, lambda m: F.col("f0").bitwiseXOR(m))).alias("point"))
    if distance == 1:
        points = hot.select("f0", F.explode(F.expr("transform(sequence(0, 63), i -> struct(f0 & ~shiftleft(1L, i) AS rest, i AS i))")).alias("point"))
    least = points.groupBy("point").agg(F.min("f0").alias("low"), F.max("f0").alias("high")).where("low < high")
    stars = points.join(least, "point").where("f0 > low").select(F.col("low").alias("a"), F.col("f0").alias("b"))
    return pairs.union(stars).distinct()


@settled("components")
def components(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links of distance or fewer bits reach.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows give repeated
    rows; a null doc_id stays null and is nobody's component unless its whole component has none. An empty
    table gives none. Equal fingerprints are one node, so copies are never expanded into pairs.
    """
    prints = written(fingerprints(docs.select("doc_id", "text"), width), "prints")
    nodes = written(prints.groupBy("f0").agg(F.min("doc_id").alias("low")), "nodes")
    edges = links_within(nodes.select("f0"), distance)
    of = connected_components(edges)
    grouped = nodes.join(of, nodes.f0 == of.node, "left").select("f0", "low", F.coalesce("component", "f0").alias("c"))
    lowest = grouped.groupBy("c").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "c").select("f0", "component_id")
    return prints.join(named, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies at a similarity


def bits_for(rows: int, similarity: float, recall: float) -> tuple[float, int, int]:
    """Share of bits in which two sets of that Jaccard similarity and of one size differ; bits of a partition, which grow with the
    logarithm of the rows so that chance buckets stay small; and how many partitions meet such a pair with that probability, in one at least."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = max(16, math.ceil(math.log2(max(rows, 1))) - 4)
    return differ, width, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** width))


def alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose texts (id, text) have that exact Jaccard similarity of their sets of word shingles, or more."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("atext")), texts.select(F.col("id").alias("b"), F.col("text").alias("btext"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = []
            for x, y in zip(batch["atext"], batch["btext"], strict=True):
                p, q = set(shingles(words_of_text(x), width)), set(shingles(words_of_text(y), width))
                near.append(len(p & q) >= similarity * len(p | q))
            yield batch.loc[near, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "atext", "btext").mapInPandas(run, "a long, b long")


def possible_in_blocks(rows: DataFrame, longs: int, most: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (key, n of the key, id, label, own, facts: n, longs of fingerprint and filled_slots()) that share a key, which one of them owns, and differ in label and in most bits or fewer, without those that cannot be alike(). Others do not become rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = []
            for r in batch.itertuples(index=False):
                i, j = np.nonzero((r.alabel[:, None] != r.blabel) & (r.aown[:, None] | r.bown))
                if not len(i):
                    continue
                x, y = (facts.reshape(len(ids), -1)[at] for facts, ids, at in ((r.afacts, r.aid, i), (r.bfacts, r.bid, j)))
                near = np.bitwise_count((x[:, 1 : longs + 1] ^ y[:, 1 : longs + 1]).view(np.uint64)).sum(1, dtype=int) <= most
                x, y, i, j = x[near], y[near], i[near], j[near]
                p, q = (v[:, longs + 1 :].view(np.uint64) for v in (np.ascontiguousarray(x), np.ascontiguousarray(y)))
                shared = np.minimum(x[:, 0] - np.bitwise_count(p & ~q).sum(1, dtype=int), y[:, 0] - np.bitwise_count(q & ~p).sum(1, dtype=int))
                may = shared * (1 + similarity) >= similarity * (x[:, 0] + y[:, 0]) - 1e-9
                some.append(np.stack([r.aid[i[may]], r.bid[j[may]]], 1))
            found = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *some]), 1), axis=0)
            yield pd.DataFrame(found, columns=["a", "b"])

    return block_pairs(rows, 64, "id", "label", "own", "facts").mapInPandas(run, "a long, b long")


def possible(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """pairs (a, b) without those that cannot be alike(): a slot that one text fills and the other leaves empty holds a shingle that the other lacks, which bounds the similarity from above."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    seen = written(filled_slots(texts.join(ends, "id", "left_semi"), width), "slots")
    side = lambda name: seen.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}{c}") for c in seen.columns[1:]])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_be_alike(similarity)).select("a", "b")


def filled_slots(texts: DataFrame, width: int) -> DataFrame:
    """id, n (distinct shingles) and s0, s1, ...: the slots that the text's shingles fill, as bits, of each of texts (id, text)."""
    longs = [f"s{i}" for i in range(SLOTS // 64)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, slots = [], np.zeros((len(batch), len(longs)), np.int64)
            for i, text in enumerate(batch["text"]):
                grams = set(shingles(words_of_text(text), width))
                full = np.zeros(SLOTS, bool)
                full[np.fromiter((xxhash.xxh64_intdigest(g) % SLOTS for g in grams), np.int64, len(grams))] = True
                sizes.append(len(grams))
                slots[i] = np.packbits(full).view("<i8")
            yield pd.DataFrame({"id": batch["id"], "n": np.array(sizes, np.int32)} | dict(zip(longs, slots.T, strict=True)))

    return texts.select("id", "text").mapInPandas(run, ", ".join(["id long", "n int", *(f"{c} long" for c in longs)]))


def _may_be_alike(similarity: float) -> Column:
    """Whether two rows of filled_slots(), with a and b before their columns' names, may have that similarity: each shared shingle is in a slot that both fill."""
    lacks = lambda x, y: sum(F.bit_count(F.col(f"{x}s{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}s{i}")))) for i in range(SLOTS // 64))
    most = F.least(F.col("an") - lacks("a", "b"), F.col("bn") - lacks("b", "a"))
    return most * (1 + similarity) >= similarity * (F.col("an") + F.col("bn")) - 1e-9


def labels_of(links: DataFrame) -> DataFrame:
    """id and label of the ends of links (a, b): of the end itself and those it is linked to, the one with most links (then the least id), and of that one the same again. Rows of one label lie in one component."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
    degree = both.groupBy("id").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("to")).alias("no")))
    over = both.join(degree.withColumnRenamed("id", "to"), "to").groupBy("id").agg(best.alias("best"))
    one = written(over.join(degree, "id").select("id", F.greatest("best", F.struct("n", (-F.col("id")).alias("no"))).alias("top")).select("id", (-F.col("top.no")).alias("label")), "labels")
    return one.join(one.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label"))


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """pairs (a, b) whose rows of named (id, label) differ in label."""
    of = lambda side: named.select(F.col("id").alias(side), F.col("label").alias(f"{side}label"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where("alabel != blabel").select("a", "b")


def near_links(nodes: DataFrame, longs: int, parts: list[Partition], most: int, texts: DataFrame, width: int, similarity: float, bucket: int = BUCKET, turns: int = 2, likely: int | None = None) -> DataFrame:
    """Links (a, b) between ids of nodes (id, f0, ...) that share a key of parts, differ in most bits or fewer of all longs and whose texts (id, text) are alike().

    Crowded buckets, those of over bucket rows, come first. In the first turn their rows are checked against a pivot, the one that shares most crowded
    buckets, which is the text the others are copies of, if there is one. In each further turn the pivot is such a row among those that no
    pivot of the bucket has the label of, and it is checked against the rows of other labels, until a turn adds no link. Last, every pair of different labels in any bucket is checked, crowded or
    not, so none is left out that would join two groups: those that differ in likely bits (by default most) or fewer first, then the others whose labels still differ. In the turns only pairs within likely bits are checked. The turns alone make few pairs of a large group of near copies; rows that share a bucket with very many others and are near to none of them are compared with them all, but in blocks, by
    their fingerprints and slots, so that only pairs which may be alike() become rows.
    """
    likely = most if likely is None else likely
    first = ["f0", "f1"][:longs]
    coarse = most * 64 * len(first) / (64 * longs)
    coarse += 3 * math.sqrt(coarse)
    every = [f"f{i}" for i in range(longs)]

    def differing(fields: list[str]) -> Column:
        bits = [F.bit_count(F.col(f"a{f}").bitwiseXOR(F.col(f"b{f}"))) for f in fields]
        return sum(bits[1:], bits[0])

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("key", F.col("id").alias(name), F.col("label").alias(f"{name}label"), *[F.col(f).alias(f"{name}{f}") for f in first])

    def close(pairs: DataFrame, tried: DataFrame | None, limit: int) -> DataFrame:
        """The pairs (a, b) that differ in limit of all bits or fewer, with that number, and were not tried before."""
        left = nodes.select(F.col("id").alias("a"), *[F.col(f).alias(f"a{f}") for f in every])
        right = nodes.select(F.col("id").alias("b"), *[F.col(f).alias(f"b{f}") for f in every])
        found = pairs.join(left, "a").join(right, "b").select("a", "b", differing(every).alias("bits")).where(F.col("bits") <= limit)
        return written(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "close")

    def joined(pairs: DataFrame) -> DataFrame:
        return written(alike(pairs.select("a", "b"), texts, width, similarity), "links")

    def labelled(rows: DataFrame, links: DataFrame | None) -> DataFrame:
        if links is None:
            return rows.withColumn("label", F.col("id"))
        return rows.join(labels_of(links), "id", "left").withColumn("label", F.coalesce("label", "id"))

    keys = signatures(nodes, parts, True, "id", *first)
    crowded = written(keys.where("own").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "crowded")
    tried = links = used = None
    if not crowded.isEmpty():
        busy = written(keys.join(crowded, "key"), "busy")
        rank = written(busy.where("own").groupBy("id").agg(F.sum("n").alias("rank")), "rank")
        busy = busy.drop("n")
        for turn in range(turns):
            rows = written(labelled(busy.join(rank, "id", "left"), links), "labelled")
            mine = rows.where("own")
            if used is not None:
                mine = mine.join(labelled(used, links).select("key", "label").distinct(), ["key", "label"], "left_anti")
            top = mine.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("no"))).alias("top"))
            pivots = written(top.select("key", (-F.col("top.no")).alias("id")), "pivots")
            used = pivots if used is None else used.union(pivots)
            pairs = side(rows, "a").join(side(mine.join(pivots, ["key", "id"], "left_semi"), "b"), "key").where((F.col("alabel") != F.col("blabel")) & (differing(first) <= coarse))
            some = close(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tried, likely)
            new = joined(some)
            tried, links = (some, new) if tried is None else (tried.union(some), links.union(new))
            if new.isEmpty():
                break
    named = labelled(nodes, links)
    rest = signatures(named, parts, True, "id", "label", *first)
    other = (F.col("a") < F.col("b")) & (F.col("alabel") != F.col("blabel"))
    small = rest.join(crowded, "key", "left_anti")
    pairs = side(small, "a").join(side(small.where("own"), "b"), "key").where(other & (differing(first) <= coarse)).select("a", "b")
    if tried is not None:
        # A crowded bucket's rows meet in blocks, with all that refutes a pair, so of the pairs that cannot be near copies no row is made.
        large = written(labelled(busy, links).select("key", "id", "label", "own"), "crowded-labels")
        split = large.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low != high").select("key", "n")
        large = written(large.join(split, "key").select("key", "n", "id", "label", "own"), "large")
        ids = large.select("id").distinct()
        facts = written(filled_slots(texts.join(ids, "id", "left_semi"), width).join(nodes.select("id", *every), "id"), "facts")
        large = large.join(facts.select("id", F.array(F.col("n").cast("long"), *every, *[c for c in facts.columns if c[0] == "s"]).alias("facts")), "id")
        pairs = pairs.union(possible_in_blocks(large, longs, most, similarity))
    rest = close(pairs.distinct(), tried, most)
    new = joined(rest.where(F.col("bits") <= likely))
    links = new if links is None else links.union(new)
    open_ = written(_apart(rest.where(F.col("bits") > likely), labelled(nodes, links)), "open")
    return links.union(joined(written(possible(open_, texts, width, similarity), "possible"))).distinct()


@settled("groups")
def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """doc_id, h (a hash of the text, so that rows which share an id are told apart) and keep, for each distinct pair of them of docs whose doc_id is not null:
    keep holds for the smallest of each group of near copies that links reach.

    SimHash over the distinct shingles of width words. As many bits are taken as let recall of the pairs at just that similarity (and nearly all
    more similar ones) meet in a partition; which bits stand together and each partition's threshold come from plan(). Pairs up to three standard
    deviations beyond the expected distance go on to the exact similarity, which decides. Texts of one fingerprint are one node. Empty and null texts have fingerprint zero and are one group.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    differ, bits, m = bits_for(rows.count(), similarity, recall)
    longs = -(-m * bits // 64)
    every = [f"f{i}" for i in range(longs)]
    prints = written(fingerprints(rows, width, longs, distinct=True, keep=("doc_id", "h")), "prints")
    low = prints.groupBy(*every).agg(F.min(F.struct("doc_id", "h")).alias("low"))
    nodes = written(low.select(F.monotonically_increasing_id().alias("id"), "low", *every), "nodes")
    # The texts that stand for the nodes, read several times: equal rows of a node's text give it once.
    texts = rows.join(nodes.select("id", "low.doc_id", "low.h"), ["doc_id", "h"]).groupBy("id").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")
    n, both = bit_statistics(nodes, longs)
    count = 64 * longs // bits
    parts = plan(n, both, count - 1, range(count, count + 1), most=1)
    most = math.floor(differ * 64 * longs + 3 * math.sqrt(differ * (1 - differ) * 64 * longs))
    links = near_links(nodes.drop("low"), longs, parts, most, texts, width, similarity, likely=math.floor(differ * 64 * longs))
    of = connected_components(links)
    named = nodes.join(of, nodes.id == of.node, "left").select(*every, "low", F.coalesce("component", "id").alias("group"))
    least = named.groupBy("group").agg(F.min("low").alias("least"))
    kept = named.join(least, "group").where("low = least").select("low.doc_id", "low.h", F.lit(True).alias("keep"))
    return prints.select("doc_id", "h").distinct().join(kept, ["doc_id", "h"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group the row of the smallest doc_id stays (then of the least text hash), and of rows equal in doc_id and text
    the least in its other columns. Rows without a doc_id stay; empty and null texts are one group; an empty table gives none."""
    kept = near_groups(docs, width, similarity).where("keep")
    id_, h = unused(docs, "id"), unused(docs, "h")
    keyed = docs.where("doc_id is not null").withColumns({id_: F.col("doc_id").cast("long"), h: F.xxhash64("text")})
    kept = keyed.join(kept.select(F.col("doc_id").alias(id_), F.col("h").alias(h)), [id_, h], "left_semi")
    # One row of each key: few keys have more, so the rows of a key are numbered where they lie.
    least = kept.groupBy(id_, h).agg(F.count("*").alias("n"))
    again = written(least.where("n > 1").select(id_, h), "repeated")
    if not again.isEmpty():
        no = unused(docs, "no")
        others = [F.col(c) for c in docs.columns if c != "text" and not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
        some = kept.join(again, [id_, h], "left_semi").withColumn(no, F.row_number().over(W.partitionBy(id_, h).orderBy(*others))).where(F.col(no) == 1)
        kept = kept.join(again, [id_, h], "left_anti").unionByName(some.drop(no))
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, distance=2)
