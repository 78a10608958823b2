"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, table, unused, words_of, written

WEIGHTS = (5, 2, 1)
#: The fraction of the golden ratio, and of 65,536 times it: together they keep points of very late slots exact.
GOLDEN = 0.6180339887498949
GOLDEN_64K = float(65536 * (Decimal(5).sqrt() - 1) / 2 % 1)
BINS = 4096
#: Blocks of a small source, one for each word if it has fewer: so many slots that a target can be met.
LEAST_BLOCKS = 64


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row per source of sized (source, size): number, weight, size, n_docs and target words.

    Targets share the total by weight; a target above cap times its source's size stops there and what
    it leaves is shared again by weight until none is above. That ends at target = min(cap * size,
    level * weight) for one level, found from prefix sums in the order in which sources fill up.
    The windows run over one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("source_no", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", F.col("source_size") * F.lit(cap))
    fills = W.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before, rest = fills.rowsBetween(W.unboundedPreceding, -1), fills.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    s = s.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("open", F.col("level") <= F.col("limit") / F.col("weight"))
    s = s.withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    target = F.least(F.col("limit"), F.coalesce(F.col("final") * F.col("weight"), F.col("limit")))
    return s.select("source_no", "source", "source_size", "n_docs", "weight", target.alias("target"))


def block_words(total: int) -> int:
    """Words of a block: a millionth of the corpus, 16 at least and 4,096 at most."""
    return min(4096, max(16, total // 1_000_000))


def _block_of(word: str) -> str:
    """SQL: the block of a word's place in its source, of whose n_blocks blocks the first `longer` have one word more than the `even` of the others."""
    return f"(CASE WHEN {word} < longer * (even + 1) THEN {word} div (even + 1) ELSE longer + ({word} - longer * (even + 1)) div greatest(even, 1) END)"


def _start(block: Column) -> Column:
    return block * F.col("even") + F.least(block, F.col("longer"))


@settled("mix")
def mix(docs: DataFrame, weights=WEIGHTS, cap: int = 3, seed: str = "mix") -> DataFrame:
    """Mix docs (doc_id, text, source) to the target weights of their sources.

    A source's documents, shuffled by a digest of their ids and texts and laid end to end, are cut into blocks of equal
    size (to one word): of block_words() words, smaller in small sources. A schedule has a slot for every block to be taken. Slot k's
    point, the fraction of k times the golden ratio, falls into one source's stretch of the cumulative slots, so that every stretch of the
    schedule holds sources in proportion. The source's r-th slot takes block r modulo its blocks, until it has the slots that its
    target needs: stretches are a few slots longer than that, as points fall unevenly by a few. So a source's taken words are its
    target to one block, and no block is taken more than cap times. Ranks and running sums go through chunks, so no window holds a whole source.

    Returns doc_id, size, source_size, target, taken (words, repeats counted), source, blocks (pieces of
    blocks the document lies in). Null and empty texts have size 0 and taken 0; a null source is a source
    of its own, last in order; repeated rows and ids are separate documents, and rows equal in id, source and text may change places; an empty table gives none.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = written(sized.withColumn("row_no", F.monotonically_increasing_id()), "sizes")
    targets = written(source_targets(sized, weights, float(cap)), "targets")
    total, n_docs = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    block = block_words(total)
    cut = targets.where("source_size > 0").withColumn("n_blocks", F.greatest(F.ceil(F.col("source_size") / block), F.least("source_size", F.lit(LEAST_BLOCKS))))
    cut = cut.withColumns({"even": F.expr("source_size div n_blocks"), "longer": F.col("source_size") % F.col("n_blocks"), "quota": F.least(F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("long"), F.col("n_blocks") * cap)})
    slack = 8 + math.ceil(math.log(total + 2))
    cut = written(cut.withColumn("slots", F.col("quota") + slack), "cut")
    n_slots = cut.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    # Documents end to end: chunks of the shuffled order, their sums, then running sums within a chunk.
    n_chunks = max(256, n_docs // 20_000)
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed), F.col("text_hash").cast("string")))
    same = sized.source.eqNullSafe(targets.source)
    laid = sized.join(targets.select("source", "source_no"), same).select("row_no", "source_no", "size", key.alias("key"), F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(n_chunks)).alias("chunk"))
    sums = laid.groupBy("source_no", "chunk").agg(F.sum("size").alias("chunk_size"))
    ahead = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_no", "chunk", F.coalesce(F.sum("chunk_size").over(ahead), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source_no", "chunk").orderBy("key", "row_no").rowsBetween(W.unboundedPreceding, -1)
    laid = laid.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source_no", "chunk"]).withColumn("begin", F.col("offset") + F.col("within"))
    laid = laid.where("size > 0").join(cut.select("source_no", "even", "longer"), "source_no")
    pieces = laid.select("row_no", "source_no", "even", "longer", "begin", (F.col("begin") + F.col("size")).alias("end"), F.explode(F.expr(f"sequence({_block_of('begin')}, {_block_of('(begin + size - 1)')})")).alias("block"))
    pieces = pieces.select("row_no", "source_no", "block", (F.least("end", _start(F.col("block") + 1)) - F.greatest("begin", _start(F.col("block")))).alias("words"))

    # Sources own stretches of [0, 1); a stretch is listed under every bin it touches, for an equi-join.
    upto = F.sum("slots").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0))
    stretches = cut.withColumn("hi", upto / F.lit(float(max(n_slots, 1)))).withColumn("lo", F.lag("hi", 1, 0.0).over(W.orderBy("source_no")))
    last = F.col("source_no") == F.max("source_no").over(W.partitionBy(F.lit(1)))
    stretches = stretches.withColumn("hi", F.when(last, 2.0).otherwise(F.col("hi"))).select("source_no", "lo", "hi", "n_blocks", "quota", F.explode(F.expr(f"sequence(int(floor(lo * {BINS})), int(least(floor(hi * {BINS}), {BINS - 1})))")).alias("bin"))
    point = F.expr("id div 65536") * GOLDEN_64K + (F.col("id") % 65536 + 0.5) * GOLDEN
    slots = spark.range(n_slots).select("id", (point - F.floor(point)).alias("x")).withColumn("bin", F.floor(F.col("x") * BINS).cast("int"))
    slots = slots.join(stretches, "bin").where("x >= lo and x < hi").select("id", "source_no", "n_blocks", "quota", F.expr("id div 65536").alias("part"))
    counts = slots.groupBy("source_no", "part").agg(F.count("*").alias("n"))
    counts = counts.select("source_no", "part", F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = slots.withColumn("r", F.row_number().over(W.partitionBy("source_no", "part").orderBy("id")) - 1).join(counts, ["source_no", "part"]).withColumn("rank", F.col("earlier") + F.col("r"))
    uses = ranked.where("rank < quota").groupBy("source_no", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("times"))

    taken = pieces.join(uses, ["source_no", "block"], "left").groupBy("row_no").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"), F.count("*").alias("blocks"))
    out = sized.join(targets.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).join(taken, "row_no", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", F.coalesce("blocks", F.lit(0)).alias("blocks"), "text_hash")


def repeated(docs: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """docs as often as mix() takes them: the words taken over the document's size, rounded up. What it takes no word of goes.

    Documents are told apart by doc_id, source and text; equal rows are taken together, and one of them stands for all. Null and empty texts go; an empty table gives none.
    """
    keys = [unused(docs, c) for c in ("id", "source", "hash")]
    times, rows_, copy = (unused(docs, c) for c in ("times", "rows", "copy"))
    copies = mix(docs, weights, cap).where("taken > 0").select(F.struct("doc_id").alias(keys[0]), F.struct("source").alias(keys[1]), F.col("text_hash").alias(keys[2]), F.ceil(F.col("taken") / F.col("size")).alias("n"))
    copies = copies.groupBy(*keys).agg(F.sum("n").cast("int").alias(times), F.count("*").alias(rows_))
    keyed = docs.withColumns({keys[0]: F.struct("doc_id"), keys[1]: F.struct("source"), keys[2]: F.xxhash64("text")}).join(copies, keys)
    rows = keyed.where(F.col(rows_) == 1).unionByName(keyed.where(F.col(rows_) > 1).dropDuplicates(keys))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
