"""Token-id files: blocks of ids, shuffled into byte or bit planes, compressed plane by plane, with a chunk index."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Recent, scratch_path, table

BLOCK = 1 << 16
CACHE = 400_000
MAGIC = b"BPL1"
#: Reflected polynomial of CRC-32 (a fixed value).
POLYNOMIAL = 0xEDB88320

CHUNK_SCHEMA = "part int, chunk int, first long, n_ids int, data binary, doc_nos array<long>, doc_ids array<long>, has_id array<boolean>, piece_nos array<int>, piece_lens array<int>, whole array<boolean>"


# ---------------------------------------------------------------- blocks


def pack_block(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """ids (uint32) as planes: byte k (or bit k) of every id together, each plane compressed by itself."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1) if bits else raw.T
    squeeze = zstandard.ZstdCompressor(level=level).compress
    parts = [squeeze(np.ascontiguousarray(p).tobytes()) for p in planes]
    return MAGIC + struct.pack(f"<II{len(parts)}I", len(ids), len(parts), *map(len, parts)) + b"".join(parts)


def unpack_block(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, planes = struct.unpack_from("<II", data, 4)
    sizes = struct.unpack_from(f"<{planes}I", data, 12)
    at, out, expand = 12 + 4 * planes, [], zstandard.ZstdDecompressor().decompress
    for size in sizes:
        out.append(np.frombuffer(expand(data[at : at + size]), np.uint8))
        at += size
    grid = np.stack(out)
    raw = np.packbits(np.unpackbits(grid, axis=1, count=n).T, axis=1, bitorder="little") if planes == 32 else np.ascontiguousarray(grid.T)
    return raw.reshape(-1).view("<u4")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC's; bit 31 is the constant term."""
    out, mask = 0, 1 << 31
    while mask:
        if a & mask:
            out ^= b
        mask >>= 1
        b = (b >> 1) ^ POLYNOMIAL if b & 1 else b >> 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the second's length."""
    power, square, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            power = _times(square, power)
        square, n = _times(square, square), n >> 1
    return _times(power, first) ^ second


# ---------------------------------------------------------------- encoding


#: Of these characters lower case, composition and classes are the same for Python and for the vocabulary's own pattern.
_PLAIN = range(0x180)
_OTHER = re.compile(r"[^\x00-\u017f]|\u0130|<\|")


def _of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in _PLAIN if unicodedata.category(chr(c))[0] == kind)


#: The vocabulary's pattern (a fixed value) for those characters in lower case.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^\t-\r \x85\xa0{_of('L')}{_of('N')}]+")


class CachedTokenizer:
    """Encodes by the tokenizers library; the ids of a text's pieces are looked up once they are known.

    The vocabulary's normaliser puts text into lower case and its pattern matches no white space, so a text's ids are those of the
    pattern's matches, one after the other, each encoded by the library's model. Texts with characters beyond Latin ones, or with
    what may be a special token, are cut at spaces only, which the pattern never crosses either; there the library does the rest.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The character that stands for each byte in the vocabulary: bytes with a visible one keep it, the rest take those from 256 on.
        visible = {ord(c) for c in ByteLevel.alphabet() if ord(c) < 256}
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.pieces, self.stretches = Recent(self._piece, CACHE), Recent(self._stretch, CACHE)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, stretch: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([stretch], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        text = text or ""
        if _OTHER.search(text):
            return b"".join(map(self.stretches.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))


@lru_cache(2)
def tokenizer(path: str) -> CachedTokenizer:
    """One for each process."""
    return CachedTokenizer(path)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, files: int | None = None, bits: bool = False) -> None:
    """Write the ids of docs (doc_id, text), each followed by end_id, in ascending order of doc_id (null last), under path.

    File part k holds a range of doc_ids as one stream of ids, cut into chunks of BLOCK ids; a chunk's row has its place in the
    stream, its planes, and which documents lie in it. Documents of equal id follow each other in the order of a hash of their texts.
    A task keeps one chunk and one batch of texts in memory.
    """
    files = files or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    tie = F.xxhash64("text")
    order = (F.col("doc_id").asc_nulls_last(), tie.asc())
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encode = TaskContext.get().partitionId(), tokenizer(vocabulary).encode
        end, held, size = np.array([end_id], "<u4").tobytes(), [], 0
        chunk, first, docs_in, doc_no = 0, 0, [], -1

        def emit() -> pd.DataFrame:
            nonlocal chunk, first, held, size, docs_in
            ids = np.frombuffer(b"".join(held), "<u4")
            row = (part, chunk, first, len(ids), pack_block(ids, bits), *([d[i] for d in docs_in] for i in range(6)))
            chunk, first, held, size, docs_in = chunk + 1, first + len(ids), [], 0, []
            return pd.DataFrame([row], columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                ids, doc_no, piece = encode(text) + end, doc_no + 1, 0
                has_id, at, n = not pd.isna(doc_id), 0, len(ids) // 4
                while at < n:
                    take = min(n - at, BLOCK - size)
                    held.append(ids[4 * at : 4 * (at + take)])
                    docs_in.append((doc_no, int(doc_id) if has_id else 0, has_id, piece, take, take == n))
                    at, size, piece = at + take, size + take, piece + 1
                    if size == BLOCK:
                        yield emit()
        if size:
            yield emit()

    laid.mapInPandas(run, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files under path: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, computed from the ids read.

    Chunks are decoded independently. The few documents that lie in several chunks meet by their number, each
    with a count and a CRC for every chunk, never their ids.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    schema = "part int, doc_no long, doc_id long, has_id boolean, begin long, piece int, whole boolean, n long, crc long"
    lists = {"doc_no": "doc_nos", "doc_id": "doc_ids", "has_id": "has_id", "piece": "piece_nos", "whole": "whole", "n": "piece_lens"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            begins, crcs = [], []
            for first, data, lens in zip(batch["first"], batch["data"], batch["piece_lens"], strict=True):
                raw, ends = memoryview(unpack_block(data).tobytes()), np.cumsum(np.asarray(lens, np.int64))
                starts = ends - lens
                begins.append(first + starts)
                crcs += [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            if len(batch):
                found = {name: np.concatenate(batch[held].to_list()) for name, held in lists.items()}
                yield pd.DataFrame({"part": np.repeat(batch["part"].to_numpy(), batch["piece_lens"].map(len)), **found, "begin": np.concatenate(begins), "crc": crcs})

    pieces = chunks.mapInPandas(run, schema).withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id")))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ns, crcs = [], []
            for found in batch["pieces"]:
                crc, n = 0, 0
                for p in sorted(found, key=lambda p: p["piece"]):
                    crc, n = joined_crc(crc, p["crc"], 4 * p["n"]), n + p["n"]
                ns.append(n)
                crcs.append(crc)
            yield pd.DataFrame({"part": batch["part"], "doc_id": batch["doc_id"], "begin": batch["begin"], "n": ns, "crc": crcs})

    small = "part int, doc_id long, begin long, n long, crc long"
    split = pieces.where("not whole").groupBy("part", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.min("begin").alias("begin"), F.collect_list(F.struct("piece", "n", "crc")).alias("pieces"))
    found = pieces.where("whole").select("part", "doc_id", "begin", "n", "crc").union(split.select("part", "doc_id", "begin", "pieces").mapInPandas(combine, small))
    # One row per file: where its stream begins.
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("ahead"))
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("ahead") + F.col("begin")).cast("long").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have the end id alone; repeated rows are documents of their own; an empty table gives no row."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
