"""Merkle manifests of a dataset: a tree for each source and one over the sources, with a proof for every row.

A row's place among its source's rows comes from counts by the digits of doc_id, level by level, so nothing is sorted as a whole. The tree is a trie over the places'
digits in the base of the fan-out: nodes that share all digits but the last are one run, and runs are hashed from the longest prefix up.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, table, written

FANOUT = 16
#: Bits of a digit of doc_id: so many counts, of 2 to that power, are summed up side by side.
DIGIT = 10
#: Rows equal in all fields are counted in so many parts.
PARTS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and itself, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The hash of a row with that text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)), 256)


def tampered_text() -> Column:
    """The text with its A-Z in lower case."""
    return F.translate("text", string.ascii_uppercase, string.ascii_lowercase)


def chosen_rows(every: int = 5) -> Column:
    """Whether the CRC-32 of doc_id in decimal digits is divisible by every; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


def leaves(docs: DataFrame, changed: Column, chosen: Column) -> DataFrame:
    """tree, doc_id, leaf and tampered (the leaf with the changed text where chosen, else null) of each row, and copy, which deals out rows that are equal.

    tree is the source, so marked that null comes first and apart from the empty one. Texts end here: everything after works on hashes.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    copy = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("leaf"), F.when(chosen, leaf_of(changed)).alias("tampered"), copy.alias("copy"))


def digit_shifts(low: int, high: int, width: int = DIGIT) -> list[int]:
    """By how many bits ids from low to high are shifted for one digit, two digits and so on; the last is 0. Bits that all ids share are passed over."""
    bits = 64 if low < 0 <= high else (low ^ high).bit_length()
    return [max(0, bits - width * k) for k in range(1, max(1, math.ceil(bits / width)) + 1)]


def _ahead(counts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """counts with ahead: the sum of n of the rows before, in order, of the same keys."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("ahead", F.coalesce(F.sum("n").over(w), F.lit(0)))


def ranked(rows: DataFrame) -> DataFrame:
    """tree, rank (from 0, by doc_id with null first, then leaf), size (the tree's rows), doc_id, leaf and tampered for each of rows, the table of leaves().

    Counts are rolled up from the leaf's first digits to doc_id and from digit to digit, and places come down again: the counts beside one another of
    one prefix are summed up by a window of at most 2 to the power of DIGIT of them (65,536 for a leaf's digits), so no task has a tree or a doc_id whole.
    """
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    shifts = digit_shifts(low, high)
    units = rows.groupBy("tree", "doc_id", "leaf", "copy").agg(F.count("*").alias("n"), F.first("tampered").alias("tampered"))
    keyed = units.select("*", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(low)).alias("id"), F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int").alias("digits"))
    units = written(keyed, "units")
    parent = ["tree", "known"]
    fine = units.groupBy(*parent, "id", "digits").agg(F.sum("n").alias("n"))
    counts = [written(fine.groupBy(*parent, "id").agg(F.sum("n").alias("n")), "counts")]
    for below, above in zip(shifts[:0:-1], shifts[-2::-1], strict=True):
        up = F.shiftright("id", above - below).alias("id")
        counts.append(counts[-1].groupBy(*parent, up).agg(F.sum("n").alias("n")))
    tops = counts[-1].groupBy(*parent).agg(F.sum("n").alias("n"))
    sizes = tops.groupBy("tree").agg(F.sum("n").alias("size"))
    places = _ahead(tops, ["tree"], ["known"]).join(sizes, "tree").select(*parent, F.col("ahead").alias("start"), "size")
    for k, count in enumerate(reversed(counts)):
        last = F.shiftright("id", shifts[k - 1] - shifts[k]) if k else F.lit(0)
        own = _ahead(count.withColumn("up", last), [*parent, "up"], ["id"])
        above = places.withColumnRenamed("id", "up") if k else places.withColumn("up", F.lit(0))
        places = own.join(above, [*parent, "up"]).select(*parent, "id", (F.col("start") + F.col("ahead")).alias("start"), "size")
    own = _ahead(fine, [*parent, "id"], ["digits"])
    places = own.join(places, [*parent, "id"]).select(*parent, "id", "digits", (F.col("start") + F.col("ahead")).alias("start"), "size")
    own = _ahead(units, [*parent, "id", "digits"], ["leaf", "copy"])
    placed = own.join(places, [*parent, "id", "digits"])
    first = F.col("start") + F.col("ahead")
    return placed.select("tree", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("rank"), "size", "doc_id", "leaf", "tampered")


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """tree, at, size, kids and hash: the runs of FANOUT of nodes (tree, at, size, hash, and more), each hashed; the only node of a tree stands for itself."""
    kid = F.struct((F.col("at") % FANOUT).alias("i"), "hash", *more)
    runs = nodes.groupBy("tree", F.shiftright("at", FANOUT.bit_length() - 1).alias("at")).agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.first("size").alias("size"))
    joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["hash"]), ""), 256)
    return runs.withColumn("hash", F.when(F.col("size") == 1, F.col("kids")[0]["hash"]).otherwise(joined))


def trie(nodes: DataFrame, most: int, *more: str) -> list[DataFrame]:
    """The levels of runs over nodes (tree, at, size, hash), from the leaves up, until trees of up to most nodes have one node left; more columns stay with the leaves."""
    levels = [written(_runs(nodes, *more), "runs")]
    while (most := -(-most // FANOUT)) > 1:
        above = levels[-1].select("tree", "at", F.ceil(F.col("size") / FANOUT).alias("size"), "hash")
        levels.append(written(_runs(above), "runs"))
    return levels


def paths_down(levels: list[DataFrame], tops: DataFrame, *more: str) -> DataFrame:
    """tree, at, hash, path, more and the further columns of tops for each leaf of levels. tops has for each tree the path from its root on.

    A path is a list of steps (left, right): the siblings before and after a node in its run, joined. A node that is alone in its tree has no step.
    """
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    down = tops.withColumn("at", F.lit(0).cast("long"))
    hashes = lambda a, start, length: F.array_join(F.transform(F.slice(a, start, length), lambda k: k["hash"]), "")
    for k, level in enumerate(reversed(levels)):
        rows = level.drop("hash").join(down, ["tree", "at"]).select("tree", "at", "size", "kids", "path", *carried, F.posexplode("kids").alias("i", "kid"))
        step = F.struct(hashes("kids", F.lit(1), F.col("i")).alias("left"), hashes("kids", F.col("i") + 2, F.lit(FANOUT)).alias("right"))
        path = F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        own = [F.col(f"kid.{c}") for c in more] if k == len(levels) - 1 else []
        down = rows.select("tree", (F.col("at") * FANOUT + F.col("i")).alias("at"), "kid.hash", path.alias("path"), *carried, *own)
        down = down if k == len(levels) - 1 else down.drop("hash")
    return down


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def _source_ranks(subroots: DataFrame) -> DataFrame:
    """subroots (tree, hash) as leaves (tree, at, size, hash, source_tree) of one tree, by the sources' bytes: ranges of them, counted, and numbered within."""
    parts = written(subroots.repartitionByRange("tree").select("tree", "hash", F.spark_partition_id().alias("part")), "sources")
    starts = _ahead(parts.groupBy("part").agg(F.count("*").alias("n")), [], ["part"]).select("part", "ahead")
    inside = F.row_number().over(W.partitionBy("part").orderBy("tree")) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(starts), "part").select(F.lit("").alias("tree"), (F.col("ahead") + F.col("inside")).alias("at"), F.lit(parts.count()).alias("size"), "hash", F.col("tree").alias("source_tree"))


@settled("manifest")
def manifest(docs: DataFrame, changed: Column | None = None, chosen: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs (doc_id, source, lang, n_chars, text; others are passed over).

    Where chosen, the text is replaced by changed before folded_root is computed with the untampered siblings; verified tells whether that gives the root. Nulls in any
    column are hashed as such; a null source is one source, before the others, and rows with a null doc_id come first in theirs. Rows that share a doc_id stand by their leaves, and equal
    rows side by side, each with its own proof. A source of one row has that leaf as its subroot, and a single source has the root. An empty table gives no row.
    """
    changed = F.col("text") if changed is None else changed
    rows = written(leaves(docs, changed, F.lit(False) if chosen is None else chosen), "leaves")
    most = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    placed = ranked(rows).select("tree", F.col("rank").alias("at"), "size", F.col("leaf").alias("hash"), "doc_id", "tampered")
    levels = trie(placed, most, "doc_id", "tampered")
    subroots = levels[-1].select("tree", "hash")
    sources = _source_ranks(subroots)
    above = trie(sources, subroots.count(), "source_tree")
    root = above[-1].select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = written(paths_down(above, root, "source_tree").select(F.col("source_tree").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "tops")
    rows = paths_down(levels, tops, "doc_id", "tampered").withColumn("folded_root", folded(F.coalesce("tampered", "hash"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents").select(*FIELDS), tampered_text(), chosen_rows())


def _oracle(depth: int = 6) -> str:
    """The same for sources of up to FANOUT to the power of depth rows."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, [*FIELDS[:-1], text])) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    turn = "list_reduce([xor(a, b)] || range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: {turn}), 4294967295)"
    with_ = [
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS tampered FROM documents)",
        "n0 AS (SELECT doc_id, source AS g, tampered, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l)",
    ]

    def up(name: str, k: int) -> str:
        return f"{name}{k + 1} AS (SELECT g, pos // {FANOUT} AS pos, CASE WHEN max(n) = 1 THEN first(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, list(h ORDER BY pos) AS kids, max(n) AS size, CAST(ceil(max(n) / {FANOUT}) AS BIGINT) AS n FROM {name}{k} GROUP BY g, pos // {FANOUT})"

    with_ += [up("n", k) for k in range(depth)]
    with_.append(f"s0 AS (SELECT true AS g, g AS source, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM n{depth})")
    with_ += [up("s", k) for k in range(depth)]
    joins, values = [], []
    for name, start in (("n", "p.pos"), ("s", "s0.pos")):
        for k in range(1, depth + 1):
            key = "p.g IS NOT DISTINCT FROM n{0}.g AND n{0}.pos = p.pos // {1}" if name == "n" else "s{0}.pos = s0.pos // {1}"
            joins.append(f"JOIN {name}{k} ON " + key.format(k, FANOUT**k))
            i = f"CAST({start} // {FANOUT ** (k - 1)} % {FANOUT} AS BIGINT)"
            values.append((f"CASE WHEN {name}{k}.size = 1 THEN '' ELSE array_to_string({name}{k}.kids[:{i}], '') END", f"CASE WHEN {name}{k}.size = 1 THEN '' ELSE array_to_string({name}{k}.kids[{i} + 2:], '') END", f"{name}{k}.size = 1"))
    columns = ", ".join(f"{a} AS l{k}, {b} AS r{k}, {c} AS e{k}" for k, (a, b, c) in enumerate(values))
    with_.append(f"j AS (SELECT p.doc_id, p.h AS leaf, n{depth}.h AS subroot, s{depth}.h AS root, coalesce(p.tampered, p.h) AS f0, {columns} FROM n0 p JOIN s0 ON s0.source IS NOT DISTINCT FROM p.g {' '.join(joins)})")
    last, proof = "j", []
    for k in range(len(values)):
        with_.append(f"f{k + 1} AS (SELECT * EXCLUDE (f{k}), CASE WHEN e{k} THEN f{k} ELSE sha256(l{k} || f{k} || r{k}) END AS f{k + 1} FROM {last})")
        last = f"f{k + 1}"
        proof += [f"l{k}", f"r{k}"]
    return f"WITH {', '.join(with_)} SELECT doc_id, leaf, subroot, root, sha256({' || '.join(proof)}) AS proof_sha256, f{len(values)} AS folded_root, f{len(values)} = root AS verified FROM {last}"


ORACLE = _oracle()
