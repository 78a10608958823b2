"""Media columns: motion-JPEG in AVI, written losslessly, read by its index, and cut into shots."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Decoding handles this many frames at a time, whatever a clip's length.
FRAMES_AT_ONCE = 2048
#: Lengths 1 to 9 have one code each: categories of differences 8, 7, ... 0. With a category's extra bits, any difference takes 9 bits.
CATEGORIES = bytes(range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Lossless JPEG (SOF3), one component of 8 bits, predicted from the left.
JPEG_HEAD = (
    b"\xff\xd8" + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + CATEGORIES)
    + _segment(0xC3, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00") + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
)


def payload_of(text: str | None) -> bytes:
    """The text's bytes and then bytes 255 up to a positive multiple of a frame."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def _differences(frames: np.ndarray) -> np.ndarray:
    """Each sample less its left one; in the first column less the one above, and 128 at the start."""
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    return d.reshape(len(x), FRAME)


def _code_table() -> np.ndarray:
    """The 9-bit code of difference d at index d + 255."""
    codes = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        length = CATEGORIES.index(size) + 1
        prefix = (1 << length) - 2  # one code of each length: 0, 10, 110, ...
        codes[d + 255] = prefix << size | (d if d >= 0 else d + (1 << size) - 1)
    return codes


CODES = _code_table()


def encode_frames(payload: bytes) -> list[bytes]:
    """A lossless JPEG for each 576 bytes."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE)
    out = []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        codes = CODES[_differences(frames[at : at + FRAMES_AT_ONCE]) + 255]
        bits = np.unpackbits(codes.astype(">u2").view(np.uint8).reshape(len(codes), FRAME, 2), axis=2)[:, :, 7:]
        for row in np.packbits(bits.reshape(len(codes), -1), axis=1):
            out.append(JPEG_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """A RIFF AVI file of one motion-JPEG stream, with an index."""
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    starts = np.cumsum([4, *map(len, chunks[:-1])])
    index = np.empty((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, starts, [len(f) for f in frames]
    body = b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[float, list[memoryview]]:
    """Frames a second, and the frames that the index lists."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, at = float(FPS), 0, None, 12
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
        if kind == b"LIST" and view[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"LIST" and view[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / struct.unpack_from("<I", view, at + 20)[0]
        elif kind == b"idx1":
            index = np.frombuffer(view[at + 8 : at + 8 + size], "<u4").reshape(-1, 4)
        at += 8 + size + (size & 1)
    if index is None:
        raise ValueError("no index")
    return fps, [view[a + 8 : a + 8 + n] for a, n in zip((index[:, 2].astype(np.int64) + movi).tolist(), index[:, 3].tolist(), strict=True)]


def _parse_jpeg(frame: memoryview) -> tuple[bytes, bytes, int, int, int]:
    """Huffman counts, categories, rows, columns, and where the scan's data begin."""
    at, counts, values, rows, columns = 2, b"", b"", 0, 0
    while True:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC4:
            counts, values = bytes(body[1:17]), bytes(body[17:])
        elif marker == 0xC3:
            rows, columns = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xDA:
            return counts, values, rows, columns, at + 2 + size
        elif marker in (0xC0, 0xC1, 0xC2):
            raise ValueError("only lossless frames (SOF3) are decoded")
        at += 2 + size


@lru_cache(16)
def _lookup(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits that may come next: the code's length and its category."""
    length, category, code, at = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            lo = code << (16 - n)
            length[lo : lo + (1 << (16 - n))], category[lo : lo + (1 << (16 - n))] = n, values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return length, category


@lru_cache(16)
def _even_table(counts: bytes, values: bytes) -> np.ndarray | None:
    """Differences by 9-bit code, if the Huffman table gives 9 bits to each."""
    length, category = _lookup(counts, values)
    table = np.zeros(512, np.int16)
    for c in range(511):
        n, size = int(length[c << 7]), int(category[c << 7])
        if n + size != 9:
            return None
        extra = c & ((1 << size) - 1)
        table[c] = extra if size and extra >> (size - 1) else extra - (1 << size) + 1 if size else 0
    return table


def _any_differences(scans: list[bytes], samples: int, counts: bytes, values: bytes) -> np.ndarray:
    """Differences of scans under any Huffman table: all scans advance together, a sample at a time."""
    length, category = _lookup(counts, values)
    width = max(map(len, scans)) + 8
    data = np.stack([np.frombuffer(s.ljust(width, b"\xff"), np.uint8) for s in scans]).astype(np.uint64)
    at, out, row = np.zeros(len(scans), np.int64), np.zeros((len(scans), samples), np.int32), np.arange(len(scans))
    for k in range(samples):
        byte = np.minimum(at >> 3, width - 5)
        word = sum(data[row, byte + i] << np.uint64(32 - 8 * i) for i in range(5))
        word = (word << (at & 7).astype(np.uint64)) & np.uint64((1 << 40) - 1)
        top = (word >> np.uint64(24)).astype(np.int64)
        n, size = length[top].astype(np.int64), category[top].astype(np.int64)
        extra = ((word >> (40 - n - size).astype(np.uint64)) & ((np.int64(1) << size) - 1).astype(np.uint64)).astype(np.int64)
        out[:, k] = np.where(size == 0, 0, np.where(extra >> np.maximum(size - 1, 0) > 0, extra, extra - (np.int64(1) << size) + 1))
        at += n + size
    return out


def decoded(frames: list[memoryview]) -> Iterator[np.ndarray]:
    """Samples (frame, row, column) of lossless JPEG frames that share one head, in blocks of FRAMES_AT_ONCE."""
    counts, values, rows, columns, start = _parse_jpeg(frames[0])
    head, samples = bytes(frames[0][:start]), rows * columns
    even = _even_table(counts, values)
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        scans = []
        for f in frames[at : at + FRAMES_AT_ONCE]:
            if f[:start] != head or f[-2:] != b"\xff\xd9":
                raise ValueError("frames of one stream must share their head")
            scans.append(bytes(f[start:-2]).replace(b"\xff\x00", b"\xff"))
        if even is not None:
            bits = np.unpackbits(np.frombuffer(b"".join(scans), np.uint8).reshape(len(scans), -1), axis=1)[:, : samples * 9].reshape(-1, 9)
            both = np.packbits(np.pad(bits, ((0, 0), (7, 0))), axis=1).view(">u2").ravel()
            d = even[both].reshape(len(scans), rows, columns)
        else:
            d = _any_differences(scans, samples, counts, values).reshape(len(scans), rows, columns)
        x = d.astype(np.int32)
        x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1) + 128
        yield (np.cumsum(x, axis=2) & 0xFF).astype(np.uint8)


def decode_frames(frames: list[memoryview]) -> np.ndarray:
    """All samples of the frames."""
    return np.concatenate(list(decoded(frames)))


def histograms(samples: np.ndarray, bins: int = 16) -> np.ndarray:
    """The share of each frame's samples in each of bins grey levels."""
    n = len(samples)
    grey = (samples.reshape(n, -1).astype(np.int64) * bins >> 8) + np.arange(n)[:, None] * bins
    return np.bincount(grey.ravel(), minlength=n * bins).reshape(n, bins) / samples[0].size


def shots(hist: np.ndarray, fps: float, window: int = 12, factor: float = 3.0, least: float = 0.2) -> list[tuple[float, float, int, int]]:
    """Clips (start s, end s, first frame, frames) by the frames' histograms: a cut stands where one differs from that before by more
    than factor times the mean difference of the window of frames before it, and by least of the samples."""
    if hist.ndim != 2:
        raise ValueError("shots() takes a histogram for each frame: two dimensions")
    n = len(hist)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    sums = np.concatenate([[0.0], np.cumsum(diff)])
    k = np.arange(len(diff))
    before = (sums[k] - sums[np.maximum(k - window, 0)]) / np.maximum(np.minimum(k, window), 1)
    cuts = [0, *(np.nonzero((diff > factor * before) & (diff > least))[0] + 1).tolist(), n]
    return [(a / fps, b / fps, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def to_media(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, n_bytes and media: every whole text as the frames of an AVI, null and empty ones as one frame. Repeated rows give repeated rows; an empty table gives none."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_bytes long", "media binary"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                out = part[list(keep)].copy()
                out["n_bytes"] = [len((t or "").encode("utf-8", "surrogatepass")) for t in part["text"]]
                out["media"] = [write_avi(encode_frames(payload_of(t))) for t in part["text"]]
                yield out

    return docs.select(*keep, "text").mapInPandas(run, schema)


def clips(media: DataFrame, *keep: str) -> DataFrame:
    """A row for each shot of each media: keep columns, shot, start_s, end_s, first_frame, n_frames. A clip has one shot at least; media must not be null."""
    schema = ", ".join([*(f"`{k}` {media.schema[k].dataType.simpleString()}" for k in keep), "shot int, start_s double, end_s double, first_frame int, n_frames int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch[[*keep, "media"]].itertuples(index=False):
                fps, frames = read_avi(values[-1])
                hist = np.concatenate([histograms(block) for block in decoded(frames)])
                rows += [(*values[:-1], i, *s) for i, s in enumerate(shots(hist, fps))]
            yield pd.DataFrame(rows, columns=[*keep, "shot", "start_s", "end_s", "first_frame", "n_frames"])

    return media.select(*keep, "media").mapInPandas(run, schema)


def digest_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what was read back from media: sizes, digests and the clips as text."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True):
                fps, frames = read_avi(data)
                size, sha, tail, hist = 0, hashlib.sha256(), b"", []
                for block in decoded(frames):
                    payload = block.tobytes()
                    size, tail = size + len(payload), payload[-32:]
                    sha.update(payload)
                    hist.append(histograms(block))
                cut = shots(np.concatenate(hist), fps)
                feature = f"{len(frames)} frames, {len(cut)} shots: " + ",".join(f"{a:.2f}-{b:.2f}" for a, b, _, _ in cut)
                rows.append((doc_id, n_bytes, size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    return media.select(F.col("doc_id").cast("long"), "n_bytes", "media").mapInPandas(run, schema)


def op7_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one frame of 255s; equal texts give equal media; an empty table gives no row."""
    return digest_media(to_media(table(spark, sf_dir, "documents"), "doc_id"))
