"""Repeated passages: anchors chosen by content, of which every long run of equal words has one, exact verification, and clusters of what to remove."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, drop_scratch, settled, table, unused, written
from .passage_runs import SHINGLE, PairedTexts
from .passage_runs import grams as _grams
from .passage_runs import mixed as _mixed
from .word_hashes import chunks, hashes_of, ranges, split_words

#: Words of an anchor: a hash of so many words that is the least of its neighbourhood.
WINDOW = 8
LEAST = 50
SIMILARITY = 0.8
CACHE = 200_000
BUCKET = 64
#: Places that share a further anchor: up to so many meet as rows, more of them in blocks.
FEW = 16
#: Words on either side of a place by which a pair of places is refuted, and how far apart, in words, one anchor of a chain may be from the next in the two texts.
AROUND, DRIFT = 104, 8
#: A key is a hub if it has over LEAST_HUB units and over one part in MOST_HUBS of all: so there are fewer hubs than MOST_HUBS.
LEAST_HUB = 1_000
MOST_HUBS = 10_000
#: Bytes of stretches that are verified at once.
VERIFIED = 1 << 24
_WORD = re.compile(r"\S+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return found


_hashes = _Hashes()


def _lower(texts: pa.Array) -> list[bytes]:
    return [text.lower().encode("utf-8", "surrogatepass") for text in texts.to_pylist()]


def _rows(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(values))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, and the list that each is of."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def _fields(structs: pa.Array, *names: str) -> list[np.ndarray]:
    return [structs.field(name).to_numpy() for name in names]


def equal_words(similarity: float = SIMILARITY, least: int = LEAST) -> int:
    """The longest run of equal words that two copies of a passage of least words or more at that similarity have at least, if its shingles are distinct.

    A replaced word takes SHINGLE shingles from either copy, an inserted one SHINGLE - 1 from the one copy and adds SHINGLE to the other; edits that are
    spread evenly leave the shortest runs. At the defaults one edit fits into 50 words, which leaves 25.
    """
    least_run = least
    for n in range(least, 40 * least):
        s = n - SHINGLE + 1
        replaced = int(s * (1 - similarity) / (SHINGLE * (1 + similarity)) + 1e-9)
        inserted = int(s * (1 - similarity) / (SHINGLE * similarity + SHINGLE - 1) + 1e-9)
        run = min(math.ceil((n - replaced) / (replaced + 1)), math.ceil(n / (inserted + 1)))
        least_run = min(least_run, run)
    return max(WINDOW, least_run)


def anchors_of(words: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of a text's anchors, and their keys: of every run words that follow each other, the WINDOW words of the least hash (each, if several have it).

    Whether words are an anchor is told by run words around them at most, so every stretch of run equal words has the same anchor in both texts, whatever stands
    around it and however often it repeats; of random words, one in (run - WINDOW + 2) / 2 is one.
    """
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    return anchored(h, np.array([0, len(h)]), run)


def anchored(h: np.ndarray, bound: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """anchors_of() of texts that follow each other, by the hashes of their words; bound: the first word of each, and how many there are."""
    if len(h) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(bound)
    end, size = np.repeat(bound[1:], size), np.repeat(size, size)
    g = _grams(h, WINDOW)
    wide = run - WINDOW + 1

    def over(x: np.ndarray, best: np.ufunc) -> np.ndarray:
        """best of each wide values of x, by doubling."""
        have = 1
        while have < wide:
            step = min(have, wide - have)
            x, have = best(x[:-step], x[step:]), have + step
        return x

    low = over(g, np.minimum)
    low[np.arange(run, len(h) + 1) > end[: len(low)]] = 0
    edge = np.zeros(wide - 1, np.uint64)
    first = np.nonzero(over(np.concatenate([edge, low, edge]), np.maximum) == g)[0]
    first = first[(first + WINDOW <= end[first]) & (size[first] >= run)]
    return first, g[first].view(np.int64)


def _identified(docs: DataFrame) -> DataFrame:
    """doc (id and a hash of the text, so that rows which share an id are told apart) and text of the rows with an id."""
    return docs.where("doc_id is not null and text is not null").select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")).alias("doc"), "text")


def anchors(docs: DataFrame, run: int, least: int) -> DataFrame:
    """id, h, at (the anchor's first word), key and words (null) of each anchor of the texts of least words or more, and of each such text a row with words, how many it has, alone."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids, hs = _lower(batch.column("text")), batch.column("id").to_numpy(), batch.column("h").to_numpy()
            for a, b in chunks(raw):
                data, start, end, bound = split_words(raw[a:b])
                size = np.diff(bound)
                long = np.flatnonzero(size >= least)
                at, key = anchored(hashes_of(data, start, end), bound, run)
                text = np.searchsorted(bound, at, "right") - 1
                keep = size[text] >= least
                at, key, text = at[keep], key[keep], text[keep]
                yield _rows(id=ids[a + text], h=hs[a + text], at=(at - bound[text]).astype(np.int32), key=key, words=pa.nulls(len(at), pa.int32()))
                yield _rows(id=ids[a + long], h=hs[a + long], at=pa.nulls(len(long), pa.int32()), key=pa.nulls(len(long), pa.int64()), words=size[long].astype(np.int32))

    return docs.select("doc.id", "doc.h", "text").mapInArrow(found, "id long, h long, at int, key long, words int")


def whole_copies(texts: DataFrame) -> DataFrame:
    """id, h, words and rid of each text of texts (id, h, words) that a smaller id, the least of them rid, has too."""
    first = texts.groupBy("h", "words").agg(F.min("id").alias("rid"), F.count("*").alias("n")).where("n > 1").drop("n")
    return texts.join(first, ["h", "words"]).where("id > rid").select("id", "h", "words", "rid").distinct()


def _chains(pairs: list[tuple], gap: int = 64, drift: int = DRIFT) -> list[list]:
    """Runs [start, end, its start, its end in the other text, matches] of matched anchors (pairs, in order) that follow each other in both texts. They may hold several passages: matched() tells them apart."""
    every, near = [], []  # all runs; those that end within gap, so that an anchor may still join them
    for at, rat in pairs:
        near = [run for run in near if at - run[1] <= gap]
        for run in reversed(near):
            if abs((at - rat) - (run[1] - run[3])) <= drift and 0 <= at - run[1] <= gap and rat >= run[3]:
                run[1], run[3] = at, rat
                run[4] += (at, rat)
                break
        else:
            every.append([at, at, rat, rat, [at, rat]])
            near.append(every[-1])
    return every


def shared_units(units: DataFrame) -> DataFrame:
    """Those of units (id, h, at, key) whose key a text that differs has too. Most keys are one text's alone, or that of whole_copies()."""
    keys = units.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select("key")
    return units.join(keys, "key").select(units.columns)


def _with_first(units: DataFrame, first: DataFrame, wanted: Column, *columns: str) -> DataFrame:
    """units with columns of first (key, n and more) by key, of the keys that are wanted. The firsts of hubs, the keys of over LEAST_HUB units and one part in MOST_HUBS of all, are fewer than that and broadcast, so a hub's
    units stay where they are; where the hub is not wanted, they are left out there. So first has to have every hub."""
    most = max(LEAST_HUB, units.count() // MOST_HUBS)
    hubs = F.broadcast(first.where(F.col("n") > most).select("key", F.struct(*columns, wanted.alias("wanted")).alias("of")))
    told = units.join(hubs, "key", "left")
    calm = told.where("of is null").drop("of").join(first.where((F.col("n") <= most) & wanted).select("key", *columns), "key")
    return told.where("of.wanted").select(*units.columns, *[F.col(f"of.{c}").alias(c) for c in columns]).unionByName(calm.select(*units.columns, *columns))


def with_firsts(units: DataFrame) -> DataFrame:
    """Each of units (id, h, at, key) with the first of its key (rid, rh, rat: smallest document, then place), if that is another text's."""
    first = units.groupBy("key").agg(F.min(F.struct("id", "h", "at")).alias("first"), F.max(F.struct("id", "h")).alias("high"), F.count("*").alias("n")).where("n > 1")
    first = first.select("key", "n", F.col("first.id").alias("rid"), F.col("first.h").alias("rh"), F.col("first.at").alias("rat"), ((F.col("first.id") != F.col("high.id")) | (F.col("first.h") != F.col("high.h"))).alias("several"))
    return _with_first(units, first, F.col("several"), "rid", "rh", "rat").where("id != rid or h != rh")


def unlinked_first_pairs(units: DataFrame) -> DataFrame:
    """Each of units (id, h, at, key, label) with the first of its key, if that is another text's, where the two labels differ: two that are linked to one text over these words need no further pair."""
    first = units.groupBy("key").agg(F.min(F.struct("id", "h", "at", "label")).alias("first"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    first = first.select("key", "n", (F.col("low") != F.col("high")).alias("split"), F.col("first.id").alias("rid"), F.col("first.h").alias("rh"), F.col("first.at").alias("rat"), F.col("first.label").alias("rlabel"))
    return _with_first(units, first, F.col("split"), "rid", "rh", "rat", "rlabel").where("(id != rid or h != rh) and label != rlabel").select("id", "h", "at", "rid", "rh", "rat")


@settled("rest")
def unlinked_units(own: DataFrame, found: DataFrame) -> DataFrame:
    """id, h, at, key and label of those of own (with_firsts(): the first's text is left out, every unit has met it) whose key has different labels.

    A label stands for the earliest text, or the unit's own, that a found run over the unit's words links it to. So units of one label share those words by a path of links. Runs over other words do not count.
    """
    doc = F.struct("id", "h")
    spans = found.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e", F.col("rid").alias("id"), F.col("rh").alias("h"))).alias("spans"))
    covering = F.filter("spans", lambda x: (x["s"] <= F.col("at")) & (F.col("at") + WINDOW <= x["e"]))
    earliest = F.array_min(F.transform(covering, lambda x: F.struct(x["id"].alias("id"), x["h"].alias("h"))))
    label = F.coalesce(earliest, doc)
    told = written(own.join(spans, ["id", "h"], "left").select("id", "h", "at", "key", F.xxhash64(label).alias("label")), "told")
    keys = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    return _with_first(told, keys, F.col("low") != F.col("high"), "n").drop("n")


def every_pair(units: DataFrame) -> DataFrame:
    """Pairs of units (id, h, at, key, label) that share a key and differ in label: each with the first one of each earlier text."""
    # Of the earlier text the first place is enough: what stays is there.
    other = units.groupBy("key", F.col("id").alias("rid"), F.col("h").alias("rh")).agg(F.min(F.struct("at", "label")).alias("one")).select("key", "rid", "rh", F.col("one.at").alias("rat"), F.col("one.label").alias("rlabel"))
    return units.join(other, "key").where("(id > rid or (id = rid and h > rh)) and label != rlabel").select("id", "h", "at", "rid", "rh", "rat")


def sized_groups(units: DataFrame) -> DataFrame:
    """Those of units (id, h, at, key, label) whose key has different labels, with n, how many share it, and several, whether they stand in more than one text."""
    doc = F.struct("id", "h")
    sizes = units.groupBy("key").agg(F.count("*").alias("n"), F.min(doc).alias("low"), F.max(doc).alias("high"), F.min("label").alias("one"), F.max("label").alias("other"))
    sizes = sizes.select("key", "n", (F.col("low") != F.col("high")).alias("several"), (F.col("one") != F.col("other")).alias("split"))
    sizes = written(sizes.where(F.col("split") | (F.col("n") > LEAST_HUB)), "sizes")
    # Written, for it is read several times.
    return written(_with_first(units, sizes, F.col("split"), "n", "several"), "sized")


def grouped_pairs(units: DataFrame, bucket: int) -> DataFrame:
    """Pairs of units (id, h, at, key, label) that share a key and differ in label: each with the first one of each earlier text in groups of at most bucket units, in larger ones with the first of the group."""
    return _pairs_of_groups(sized_groups(units), bucket)


def _pairs_of_groups(sized: DataFrame, bucket: int) -> DataFrame:
    units = sized.where("several")
    each = every_pair(units.where(F.col("n") <= bucket).drop("n", "several"))
    return each.union(unlinked_first_pairs(units.where(F.col("n") > bucket).drop("n", "several")))


def grams_at(docs: DataFrame, places: DataFrame, before: range, width: int) -> DataFrame:
    """id, h, at, key, label: a key of the width words that begin at each number in before words before a place of places (id, h, at, label), where the text has them."""
    lists = places.groupBy("id", "h").agg(F.collect_set(F.struct("at", "label")).alias("places"))
    back = np.array(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids, hs = _lower(batch.column("text")), batch.column("id").to_numpy(), batch.column("h").to_numpy()
            for a, b in chunks(raw):
                data, start, end, bound = split_words(raw[a:b])
                keys = _grams(hashes_of(data, start, end), width).view(np.int64)
                places, text = _flat(batch.column("places").slice(a, b - a))
                at, label = _fields(places, "at", "label")
                labels, number = np.unique(label, return_inverse=True)
                to = bound[text][:, None] + at[:, None] - back
                there = (to >= bound[text][:, None]) & (to + width <= bound[text + 1][:, None])
                wanted = np.unique((to * len(labels) + number[:, None])[there])
                to, label = wanted // max(len(labels), 1), labels[wanted % max(len(labels), 1)]
                text = np.searchsorted(bound, to, "right") - 1
                yield _rows(id=ids[a + text], h=hs[a + text], at=(to - bound[text]).astype(np.int32), key=keys[to], label=label)

    return docs.select("doc.id", "doc.h", "text").join(lists, ["id", "h"]).mapInArrow(run, "id long, h long, at int, key long, label long")


def _size(gone: int | np.ndarray, lost: int | np.ndarray, share: float) -> float | np.ndarray:
    """Shingles at least of a stretch of which so many are gone in the other text, which has so many of its own; see may_repeat()."""
    return (gone * (1 - share) + share * lost) / (1 - 2 * share)


@cache
def _most_lost(size: int, width: int, share: float) -> np.ndarray:
    """By how many are gone, one more than may be lost of a stretch of that size."""
    gone, lost = np.arange(width + 1)[:, None], np.arange(width + 1)
    return (_size(gone, np.maximum(lost, (SHINGLE - 1) * (gone > 0)), share) <= size + 1e-9).sum(1).astype(np.int16)


def may_repeat(x: np.ndarray, y: np.ndarray, similarity: float, least: int) -> np.ndarray:
    """Which pairs of places may lie in or beside a passage of least words and that similarity, by x and y (a row for each pair): bytes of the 2 * AROUND shingles around either place, 0 where the text has none.

    Take of such a passage, or of a part that has at least its share of equal shingles, m shingles in x. Of these M are missing in y, of y's L in x, and L is SHINGLE - 1 at least if M is not 0: an edit takes as many from either side.
    m - M >= similarity / (1 + similarity) * (2m - M + L) follows, which bounds m from below for each M. Parts of between one and two times the least size are enough to look for. A shingle that y has within DRIFT words counts as equal, so no such pair is refused.
    """
    upto, share, least_size = _missing(x, y), similarity / (1 + similarity), least - SHINGLE + 1
    most = min(AROUND, 2 * least_size + SHINGLE + DRIFT)
    found = np.zeros(len(x), bool)
    for gone in range(AROUND):
        m = max(least_size, math.ceil(_size(gone, SHINGLE - 1, share) - 1e-9) if gone else 0)
        if m > most:
            break
        found |= (upto[:, m:] - upto[:, :-m] <= gone).any(1)
    # With what y is seen to lack, but for DRIFT shingles at either end; sizes between two steps count as the greater.
    at, step = np.nonzero(found)[0], SHINGLE
    mine, theirs, alike = upto[at], _missing(y[at], x[at]), np.zeros(len(at), bool)
    for m in range(least_size, most + 1, step):
        gone = mine[:, m:] - mine[:, :-m]
        lost = theirs[:, m - DRIFT : theirs.shape[1] - DRIFT] - theirs[:, DRIFT : theirs.shape[1] - m + DRIFT]
        alike |= (lost < _most_lost(m + step - 1, x.shape[1], share)[gone]).any(1)
    found[at] = alike
    return found


def _missing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair how many of the first 0, 1, 2, ... shingles of x are missing in y within DRIFT of their place."""
    width = x.shape[1]
    wide = np.zeros((len(y), width + 2 * DRIFT), np.uint8)
    wide[:, DRIFT:-DRIFT] = y
    missing = np.ones(x.shape, bool)
    for d in range(2 * DRIFT + 1):
        missing &= x != wide[:, d : d + width]
    missing |= x == 0
    upto = np.zeros((len(x), width + 1), np.uint8)
    np.cumsum(missing, axis=1, dtype=np.uint8, out=upto[:, 1:])
    return upto


def pairs_in_blocks(units: DataFrame, similarity: float, least: int) -> DataFrame:
    """Pairs of units (id, h, at, key, label, around, others, n if known) that share a key, differ in label and may_repeat() one another: the later text's place with the earlier one's. Others do not become rows.

    others are all keys of the place: a pair becomes a row under the least key that both have.
    """
    schema = "id long, h long, at int, rid long, rh long, rat int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, open_ = [np.zeros((0, 6), np.int64)], []

            def settle(open_: list = open_, some: list = some) -> None:
                x, y, one, two = (np.concatenate(v) for v in zip(*open_, strict=True))
                may = may_repeat(x, y, similarity, least)
                one, two = one[may], two[may]
                later = (one[:, 0] > two[:, 0]) | ((one[:, 0] == two[:, 0]) & (one[:, 1] > two[:, 1]))
                some.append(np.where(later[:, None], np.concatenate([one, two], 1), np.concatenate([two, one], 1)))
                open_.clear()

            for r in batch.itertuples(index=False):
                apart = (r.alabel[:, None] != r.blabel) & ((r.aid[:, None] != r.bid) | (r.ah[:, None] != r.bh))
                # Pairs that have a lesser key in common meet under it.
                lesser = np.concatenate([r.aothers, r.bothers])
                place = np.repeat(np.arange(len(r.aid) + len(r.bid)), np.concatenate([r.amany, r.bmany]))[lesser < r.key]
                known, number = np.unique(lesser[lesser < r.key], return_inverse=True)
                has = np.zeros((len(r.aid) + len(r.bid), len(known)), np.float32)
                has[place, number] = 1
                i, j = np.nonzero(apart & (has[: len(r.aid)] @ has[len(r.aid) :].T == 0))
                x, y = r.aaround.view(np.uint8).reshape(len(r.aid), -1), r.baround.view(np.uint8).reshape(len(r.bid), -1)
                for k in range(0, len(i), 1024):
                    p, q = i[k : k + 1024], j[k : k + 1024]
                    one, two = (np.stack([v.astype(np.int64) for v in side], 1) for side in ((r.aid[p], r.ah[p], r.aat[p]), (r.bid[q], r.bh[q], r.bat[q])))
                    open_.append((x[p], y[q], one, two))
                    if sum(len(v[2]) for v in open_) >= 1024:
                        settle()
            if open_:
                settle()
            yield pd.DataFrame(np.unique(np.concatenate(some), axis=0), columns=[x.split()[0] for x in schema.split(", ")]).astype({"at": np.int32, "rat": np.int32})

    return block_pairs(units.withColumn("many", F.size("others")), 64, "id", "h", "at", "label", "around", "others", "many").mapInPandas(run, schema)


def together(docs: DataFrame, crowded: DataFrame, run: int, reach: int, similarity: float = SIMILARITY, least: int = LEAST, few: int = FEW) -> DataFrame:
    """Pairs of crowded places (id, h, at, key, label) whose texts have a further anchor in common within reach words of them: what a passage has before or after an edit, where many texts share one side of it.

    Texts that share both are few where each side alone is quoted by many: each place meets each earlier text, however many they are; over few, in blocks that keep what may_repeat().
    """
    lists = crowded.groupBy("id", "h").agg(F.collect_set(F.struct("at", "key", "label")).alias("places"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids, hs = _lower(batch.column("text")), batch.column("id").to_numpy(), batch.column("h").to_numpy()
            for a, b in chunks(raw):
                data, start, end, bound = split_words(raw[a:b])
                hashes = hashes_of(data, start, end)
                anchors, beside = anchored(hashes, bound, run)
                places, text = _flat(batch.column("places").slice(a, b - a))
                at, key, label = _fields(places, "at", "key", "label")
                here = bound[text] + at
                near, of = ranges(*(np.searchsorted(anchors, (np.maximum(here - reach, bound[text]), np.minimum(here + reach + 1, bound[text + 1])))))
                apart = np.abs(anchors[near] - here[of]) >= WINDOW
                near, of = near[apart], of[apart]
                keys = _mixed(beside[near].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key[of].view(np.uint64))
                # Of each key the first place in each text; then the keys of each place together.
                order = np.lexsort((here[of], keys, text[of]))
                keys, of = keys[order], of[order]
                first = np.ones(len(of), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (text[of[1:]] != text[of[:-1]])
                keys, of = keys[first], of[first]
                order = np.argsort(here[of], kind="stable")
                keys, of = keys[order].view(np.int64), of[order]
                spot, start, many = np.unique(here[of], return_index=True, return_counts=True)
                spot_of = np.repeat(np.arange(len(spot)), many)
                others = keys[ranges(start[spot_of], (start + many)[spot_of])[0]]
                # Bytes of the shingles, with none between texts.
                shingles = _grams(hashes, SHINGLE)
                inside = np.flatnonzero(np.arange(SHINGLE, len(hashes) + 1) <= np.repeat(bound[1:], np.diff(bound))[: len(shingles)])
                padded = np.zeros(len(hashes) + 2 * AROUND * (b - a + 1), np.uint8)
                padded[inside + 2 * AROUND * np.searchsorted(bound, inside, "right")] = shingles[inside] % np.uint64(255) + np.uint64(1)
                low = here[of] + 2 * AROUND * (text[of] + 1) - AROUND
                around = padded[low[:, None] + np.arange(2 * AROUND)].view(np.int64)
                yield _rows(
                    id=ids[a + text[of]], h=hs[a + text[of]], at=at[of], key=keys, label=label[of],
                    around=_lists(around.ravel(), np.full(len(of), around.shape[1])), others=_lists(others, many[spot_of]),
                )

    both = docs.select("doc.id", "doc.h", "text").join(lists, ["id", "h"]).mapInArrow(found, "id long, h long, at int, key long, label long, around array<long>, others array<long>")
    both = written(both, "together")
    sizes = both.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    sized = written(both.join(sizes.where("low != high").select("key", "n"), "key"), "sized")
    drop_scratch(both)
    return every_pair(sized.where(F.col("n") <= few).drop("n", "around", "others")).union(pairs_in_blocks(sized.where(F.col("n") > few), similarity, least))


@settled("further")
def further_pairs(docs: DataFrame, rest: DataFrame, run: int, least: int, bucket: int = BUCKET) -> DataFrame:
    """Pairs for rest, unlinked_units(), which are not linked to one another over their words.

    A run of run equal words goes on for half of what an anchor leaves of it after the anchor or before it: texts that share those words too are paired, each place with
    the first one of each earlier text of a group of at most bucket. In a larger group texts meet in the first of the group, in least equal words, which need no check against each other, and where they have another anchor nearby in common (see together()).
    """
    half = -(-(run - WINDOW) // 2)
    wide = written(grams_at(docs, rest, range(0, half + 1, half), WINDOW + half), "wide")
    sized = sized_groups(wide)
    drop_scratch(wide)
    crowded = sized.where(F.col("n") > bucket).drop("n", "several")
    long = written(grams_at(docs, crowded, range(-half, run), least), "long")
    return _pairs_of_groups(sized, bucket).union(unlinked_first_pairs(long)).union(together(docs, crowded, run, least + 2 * WINDOW)).distinct()


def candidate_runs(pairs: DataFrame) -> DataFrame:
    """Runs of anchors that another text has too, from pairs (id, h, at, rid, rh, rat)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            pairs, text = _flat(batch.column("found"))
            at, rid, rh, rat = _fields(pairs, "at", "rid", "rh", "rat")
            order = np.lexsort((rat, at, rh, rid, text))
            at, rid, rh, rat, text = at[order], rid[order], rh[order], rat[order], text[order]
            other = np.ones(len(at), bool)
            other[1:] = (text[1:] != text[:-1]) | (rid[1:] != rid[:-1]) | (rh[1:] != rh[:-1])
            new = other.copy()
            new[1:] |= (at[1:] != at[:-1]) | (rat[1:] != rat[:-1])
            at, rid, rh, rat, text, first = at[new], rid[new], rh[new], rat[new], text[new], np.flatnonzero(other[new])
            matches, runs, of = list(zip(at.tolist(), rat.tolist(), strict=True)), [], []
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                found = _chains(matches[low:high])
                runs += found
                of += [low] * len(found)
            of, size = np.array(of, np.int64), np.array([len(x[4]) for x in runs], np.int64)
            ends = np.array([x[:4] for x in runs], np.int32).reshape(-1, 4)
            yield _rows(
                id=ids[text[of]], h=hs[text[of]], s=ends[:, 0].copy(), e=ends[:, 1] + np.int32(WINDOW), rid=rid[of], rh=rh[of], rs=ends[:, 2].copy(), re=ends[:, 3] + np.int32(WINDOW),
                pairs=_lists(np.array([x for r in runs for x in r[4]], np.int32), size),
            )

    # Bounded by the anchors of one text.
    grouped = pairs.groupBy("id", "h").agg(F.collect_list(F.struct("at", "rid", "rh", "rat")).alias("found"))
    return grouped.mapInArrow(run, "id long, h long, s int, e int, rid long, rh long, rs int, re int, pairs array<int>")


def _stretches(docs: DataFrame, wanted: DataFrame, pad: int) -> DataFrame:
    """For the distinct wanted (id, h, s, e): the words from pad before s to pad after e, and how many come before s. docs has a row for each text."""
    lists = wanted.distinct().groupBy("id", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids, hs = _lower(batch.column("text")), batch.column("id").to_numpy(), batch.column("h").to_numpy()
            for a, b in chunks(raw):
                data, start, end, bound = split_words(raw[a:b])
                spans, text = _flat(batch.column("spans").slice(a, b - a))
                s, e = _fields(spans, "s", "e")
                lead = np.minimum(s, pad)
                low, high = start[bound[text] + s - lead], end[np.minimum(bound[text] + e + pad, bound[text + 1]) - 1]
                whole, size, k = data.tobytes(), 0, 0
                for m, n in enumerate((high - low).tolist(), 1):
                    size += n
                    if size >= VERIFIED or m == len(low):
                        words = [whole[x:y].decode("utf-8", "surrogatepass") for x, y in zip(low[k:m].tolist(), high[k:m].tolist(), strict=True)]
                        yield _rows(id=ids[a + text[k:m]], h=hs[a + text[k:m]], s=s[k:m], e=e[k:m], lead=lead[k:m], words=pa.array(words, pa.string()))
                        size, k = 0, m

    return docs.select("doc.id", "doc.h", "text").join(lists, ["id", "h"]).mapInArrow(run, "id long, h long, s int, e int, lead int, words string")


@settled("verified")
def verified_runs(docs: DataFrame, runs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """The stretches in and around runs (chains of matched anchors) of least words or more and of that exact Jaccard similarity: whole chains, or the parts of a chain that are alike."""
    member, first = runs.select("id", "h", "s", "e"), runs.select(F.col("rid").alias("id"), F.col("rh").alias("h"), F.col("rs").alias("s"), F.col("re").alias("e"))
    texts = written(_stretches(docs, member.union(first), least), "stretches")
    other = texts.select(F.col("id").alias("rid"), F.col("h").alias("rh"), F.col("s").alias("rs"), F.col("e").alias("re"), F.col("lead").alias("rlead"), F.col("words").alias("rwords"))
    both = runs.join(texts, ["id", "h", "s", "e"]).join(other, ["rid", "rh", "rs", "re"])
    schema = "id long, h long, s int, e int, rid long, rh long, rs int, re int, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = batch.column("words"), batch.column("rwords")
            size = np.cumsum(pc.binary_length(mine).to_numpy().astype(np.int64) + pc.binary_length(theirs).to_numpy())
            part = size // VERIFIED
            for low, high in zip(first := np.flatnonzero(np.append(True, part[1:] != part[:-1])), [*first[1:], len(part)], strict=True):
                texts = pa.concat_arrays([mine.slice(low, high - low), theirs.slice(low, high - low)]).dictionary_encode()
                number = texts.indices.to_numpy()
                both = PairedTexts(texts.dictionary.cast(pa.binary()).to_pylist(), number[: high - low], number[high - low :])
                pairs, of = _flat(batch.column("pairs").slice(low, high - low))
                places, of = pairs.to_numpy().astype(np.int64).reshape(-1, 2), of[::2]
                at, rat = ((batch.column(s).to_numpy() - batch.column(lead).to_numpy())[low:high].astype(np.int64) for s, lead in (("s", "lead"), ("rs", "rlead")))
                row, s, e, t, f, alike = both.matched(both.bridged(both.blocks(of, places[:, 0] - at[of], places[:, 1] - rat[of])), similarity, least)
                ids = {c: batch.column(c).to_numpy()[low + row] for c in ("id", "h", "rid", "rh")}
                s, e, t, f = ((x + y[row]).astype(np.int32) for x, y in ((s, at), (e, at), (t, rat), (f, rat)))
                yield _rows(id=ids["id"], h=ids["h"], s=s, e=e, rid=ids["rid"], rh=ids["rh"], rs=t, re=f, similarity=alike)

    return both.mapInArrow(run, schema).distinct()


@settled("repeats")
def repeated_runs(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """Stretches (id, h, s, e) of docs (doc, text) that repeat those (rid, rh, rs, re) of an earlier text; words are counted from 0."""
    run = equal_words(similarity, least)
    rows = written(anchors(docs, run, least), "anchors")
    copies = written(whole_copies(rows.where("words is not null").select("id", "h", "words")), "copies")
    several = rows.where("words is not null").groupBy("id", "h").count().where("count > 1").limit(1).count()
    docs = docs.dropDuplicates(["doc"]) if several else docs
    units = shared_units(rows.where("words is null").select("id", "h", "at", "key"))
    units = written(units.join(copies.select("id", "h").distinct(), ["id", "h"], "left_anti"), "units")
    drop_scratch(rows)
    met = written(with_firsts(units), "met")
    drop_scratch(units)
    runs = written(candidate_runs(met.select("id", "h", "at", "rid", "rh", "rat")), "runs")
    found = verified_runs(docs, runs, similarity, least)
    drop_scratch(runs)
    rest = unlinked_units(met.select("id", "h", "at", "key"), found)
    drop_scratch(met)
    runs = written(candidate_runs(further_pairs(docs, rest, run, least)), "runs")
    whole = copies.select("id", "h", F.lit(0).alias("s"), F.col("words").alias("e"), "rid", F.col("h").alias("rh"), F.lit(0).alias("rs"), F.col("words").alias("re"), F.lit(1.0).alias("similarity"))
    return found.union(verified_runs(docs, runs, similarity, least)).distinct().union(whole)


_MERGED = "id long, h long, s int, e int, start int, end int"


def _merged(intervals: DataFrame) -> DataFrame:
    """Each interval (id, h, s, e) with the passage [start, end) of overlapping intervals of its text that it lies in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, h, spans in zip(batch["id"], batch["h"], batch["spans"], strict=True):
                group, end = [], 0
                for s, e in [*sorted((x["s"], x["e"]) for x in spans), (1 << 31, 0)]:
                    if group and s >= end:
                        rows += [(i, h, *g, group[0][0], end) for g in group]
                        group, end = [], 0
                    if e:
                        group.append((s, e))
                        end = max(end, e)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _MERGED.split(", ")])

    return intervals.distinct().groupBy("id", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans")).mapInPandas(run, _MERGED)


@settled("passages")
def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """doc_id, first_word, n_words, component_id, removed: each passage of docs (doc_id, text) that another document has too.

    component_id is the smallest doc_id whose passages links reach; removed tells whether the passage, or part of it, repeats an earlier text,
    so that drop_repeats() takes that part out. Null and empty texts and null doc_ids have no passage; equal rows count
    once; rows that share an id and differ in text are different documents; repeats inside one document are not sought; an
    empty table gives no row.
    """
    runs = repeated_runs(_identified(docs), similarity, least)
    first = runs.select(F.col("rid").alias("id"), F.col("rh").alias("h"), F.col("rs").alias("s"), F.col("re").alias("e"))
    placed = written(_merged(runs.select("id", "h", "s", "e").union(first)), "placed")
    node = lambda: F.struct("id", "h", "start")
    left = placed.select("id", "h", "s", "e", node().alias("a"))
    right = placed.select(F.col("id").alias("rid"), F.col("h").alias("rh"), F.col("s").alias("rs"), F.col("e").alias("re"), node().alias("b"))
    edges = runs.join(left, ["id", "h", "s", "e"]).join(right, ["rid", "rh", "rs", "re"]).select("a", "b")
    of = connected_components(edges)
    members = runs.select("id", "h", "s", "e").distinct().join(left, ["id", "h", "s", "e"]).select(F.col("a").alias("node")).distinct().withColumn("removed", F.lit(True))
    passages = placed.select(node().alias("node"), "end").distinct().join(of, "node").join(members, "node", "left")
    return passages.select(F.col("node.id").alias("doc_id"), F.col("node.start").alias("first_word"), (F.col("end") - F.col("node.start")).alias("n_words"), F.col("component.id").alias("component_id"), F.coalesce("removed", F.lit(False)).alias("removed"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans; what stood between the words on either side of a cut stands there once."""
    bounds = [m.span() for m in _WORD.finditer(text)]
    cut = np.zeros(len(bounds) + 1, bool)
    for s, e in spans:
        cut[max(s, 0) : min(e, len(bounds))] = True
    out, at, k = [], 0, 0
    while k < len(bounds):
        if cut[k]:
            end = k
            while end < len(bounds) and cut[end]:
                end += 1
            out.append(text[at : bounds[k][0]])
            at, k = (bounds[end][0] if end < len(bounds) else len(text)), end
        else:
            k += 1
    return "".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """docs without the passages that an earlier document (smaller doc_id) has too; n_chars, if there, follows.

    Every stretch stays where it first stands. A document of which nothing but white space would remain goes; one that had no word before stays.
    Rows without a doc_id or text stay as they are; an empty table gives none.
    """
    spans = repeated_runs(_identified(docs), similarity, least).groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    id_, h, cuts = (unused(docs, c) for c in ("id", "h", "spans"))
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), h: F.xxhash64("text")})
    joined = keyed.join(spans.withColumnsRenamed({"id": id_, "h": h, "spans": cuts}), [id_, h], "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [(x["s"], x["e"]) for x in s]) for t, s in zip(text, spans, strict=True)])

    changed = joined.where(F.col(cuts).isNotNull()).withColumn("text", cut("text", cuts)).where(F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.where(F.col(cuts).isNull()).select(docs.columns).unionByName(changed.select(docs.columns))


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
