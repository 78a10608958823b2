"""Two tokenizers side by side: where their tokens end together, and which ids stand for one another across a corpus."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, settled, table, written

#: A piece of a text that both tokenizers end at for certain goes up to a single space between other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside another white space or at an end: without one, every space is such a place.
_ODD = re.compile(r"\A | \Z|\s | \s")
#: Pieces that stay known in a task.
CACHE = 200_000
#: A pair of ids is frequent if it has over one part in so many of all rows, so there are fewer frequent pairs than that: they are broadcast.
MOST_PAIRS = 100_000
#: Characters below this are of the same kind for every version of Unicode.
LATIN = "\u0250"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligned(NamedTuple):
    """A piece in both tokenizers: how many tokens it has, its groups as text, and its links, each as a number that pair_of() gives."""

    a: int
    b: int
    groups: str
    links: tuple[int, ...]


OTHER = Aligned(0, 0, "", ())


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        values = byte_values()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(values[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        #: Where no entry goes on over a space after another character, what stands before such a space does not bear on what comes after.
        self.parted = not any(re.search("[^▁]▁", p) for p in pieces)
        self.known = Recent(lambda piece: self.learn([piece])[0], CACHE)
        self.a_matches, self.pattern = Recent(self.a_match, CACHE), regex.compile(public_tokenizers.PATTERN).findall
        self.a_chars = {b: c for c, b in values.items()}
        own = json.loads(self.a.to_str())
        self.a_plain = own["normalizer"] is None and own["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.a_said, self.b_said = ([(len(raw), str(i)) for i, raw in enumerate(side)] for side in (self.a_bytes, self.b_bytes))

    def a_ids(self, pieces: list[str]) -> list[list[int]]:
        """A's tokens of each piece with the space before it: of Latin characters by the vocabulary's pattern and, match by match, its model, of others by the whole tokenizer."""
        out: list = [None] * len(pieces)
        others = []
        for k, p in enumerate(pieces):
            if self.a_plain and max(p, default="") < LATIN:
                out[k] = [i for m in self.pattern(f" {p}") for i in self.a_matches[m]]
            else:
                others.append(k)
        for k, x in zip(others, self.a.encode_batch_fast([f" {pieces[k]}" for k in others], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def a_match(self, match: str) -> list[int]:
        return [t.id for t in self.a.model.tokenize(match.encode().decode("latin-1").translate(self.a_chars))]

    def learn(self, pieces: list[str]) -> list[Aligned]:
        """Pieces without the space before them; OTHER where the bytes of either side are others than space and text."""
        return list(map(self.pair, pieces, self.a_ids(pieces), self.b.encode(pieces, num_threads=1)))

    def pair(self, piece: str, a: list[int], b: list[int]) -> Aligned:
        """Two pointers over the tokens: the side whose tokens end earlier so far goes on, and where both ends meet a group is full."""
        raw = f" {piece}".encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return OTHER
        a_said, b_said, width = self.a_said, self.b_said, len(self.b_bytes)
        groups, links, of_a, of_b, i, j, a_end, b_end = [], [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if a_end <= b_end:
                size, said = a_said[a[i]]
                i, a_end = i + 1, a_end + size
                of_a.append(said)
            else:
                size, said = b_said[b[j]]
                j, b_end = j + 1, b_end + size
                of_b.append(said)
            if a_end == b_end:
                groups.append(f"{','.join(of_a)}|{','.join(of_b)}")
                links.append(a[i - 1] * width + b[j - 1])
                of_a, of_b = [], []
        return Aligned(len(a), len(b), ";".join(groups), tuple(links))

    def texts(self, texts: list[str | None]) -> list[list[Aligned] | None]:
        """The pieces of whole texts; None for those that are null or empty or have other bytes in either tokenizer. Pieces that are not known are encoded together."""
        parts = [self.pieces(t) if t and _plain(t) else [] for t in texts]
        known, found, missing, wanted = self.known, {}, [], set()
        rows = [list(map(known.get, pieces)) for pieces in parts]
        gaps = [None in own for own in rows]
        for pieces, own, gap in zip(parts, rows, gaps, strict=True):
            if gap:
                wanted.update([p for p, v in zip(pieces, own, strict=True) if v is None])
        for p in wanted:
            if (v := known.older.get(p)) is not None:
                found[p] = v
            else:
                missing.append(p)
        for at in range(0, len(missing), 1024):
            some = missing[at : at + 1024]
            found.update(zip(some, self.learn(some), strict=True))
        for k, gap in enumerate(gaps):
            if gap:
                rows[k] = [found[p] if v is None else v for p, v in zip(parts[k], rows[k], strict=True)]
        for p, v in found.items():
            known.put(p, v)
        return [None if not own or OTHER in own else own for own in rows]

    def pieces(self, text: str) -> list[str]:
        """A text cut at each single space between other characters, if both tokenizers end there."""
        return [text] if not self.parted else _CUT.split(text) if _ODD.search(text) else text.split(" ")


def _plain(text: str) -> bool:
    """Whether a text has no lone surrogates, which have no UTF-8."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, *keep: str) -> DataFrame:
    """keep columns of docs (doc_id, text), n_a, n_b, n_groups, n_links, groups_sha256, and links and times: each distinct pair of linked ids of the row, as a number, and how often it has it.

    Whole texts are taken, one at a time; equal pieces of a text are encoded once while they stay in use.
    """
    added = T.DataType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<bigint>, times array<int>")
    schema = T.StructType([*docs.select(*keep).schema, *added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(a_path, b_path)
        gc.disable()  # very many small objects are kept, none in cycles
        try:
            for batch in batches:
                for at in range(0, len(batch), 200):
                    part = batch.iloc[at : at + 200]
                    yield part[list(keep)].assign(**dict(zip(schema.names[len(keep) :], zip(*map(row, both.texts(part["text"].tolist())), strict=True), strict=True)))
        finally:
            gc.enable()

    def row(found: list[Aligned] | None) -> tuple:
        if found is None:
            return 0, 0, 0, 0, "", [], []
        links = np.fromiter(chain.from_iterable(p.links for p in found), np.int64)
        pairs, times = np.unique(links, return_counts=True)
        digest = hashlib.sha256(";".join(p.groups for p in found).encode()).hexdigest()
        return sum(p.a for p in found), sum(p.b for p in found), len(links), len(links), digest, pairs, times.astype(np.int32)

    return docs.select(*keep, "text").mapInPandas(run, schema)


def link_counts(rows: DataFrame, width: int) -> DataFrame:
    """link, count (how often it occurs), best (whether no other pair with its B id occurs oftener) and parts (rows with it) for each pair of links and times of rows."""
    pairs = rows.select(F.explode(F.arrays_zip("links", "times")).alias("x"))
    counts = pairs.groupBy(F.col("x.links").alias("link")).agg(F.sum("x.times").alias("count"), F.count("*").alias("parts"))
    counts = written(counts, "links")
    most = counts.groupBy((F.col("link") % width).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.col("link") % width).join(most, "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"), "parts")


def link_sums(rows: DataFrame, counts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """row, n_best and count_sum for each of rows (row, links, times) with links.

    Pairs in over one part in most of all parts (a part: a row and a pair of it) are fewer than most and broadcast; so what is shuffled by pair has few rows of each, whatever pair is in nearly every document.
    """
    parts = counts.agg(F.sum("parts")).first()[0] or 0
    frequent = F.col("parts") > max(1, parts // most)
    pairs = rows.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("link"), F.col("x.times").alias("times"))
    values = F.struct("count", "best").alias("of")
    told = pairs.join(F.broadcast(counts.where(frequent).select("link", values)), "link", "left")
    rare = told.where("of is null").select("link", "row", "times").join(counts.where(~frequent).select("link", values), "link")
    sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("of.best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("of.count") * F.col("times")).alias("count_sum"))
    both = sums(told.where("of is not null")).unionByName(sums(rare))
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


@settled("alignment")
def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text; others are passed over).

    Null and empty texts, and those that either tokenizer gives with other bytes, have no tokens and zeros. Repeated rows count as often as they stand there; a null doc_id stays. An empty table gives no row.
    """
    rows = aligned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), a_path, b_path, "doc_id").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "aligned")
    links = rows.select("row", "links", "times")
    sums = link_sums(links, written(link_counts(links, len(aligner(a_path, b_path).b_bytes)), "counts"))
    of = rows.drop("links", "times").join(sums, "row", "left")
    return of.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
