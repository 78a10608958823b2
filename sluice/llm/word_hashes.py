"""Words of many texts at once: where they stand in the texts' bytes, and their hashes, without a Python object for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash

#: Bytes of text that are taken at once.
CHUNK = 1 << 22
_PAD = bytes(40)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: The first 0 to 8 bytes of eight.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: 1: white space as str.split() has it, 2: the first byte of a character that may be some.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 2


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of CHUNK bytes or one text at least."""
    low, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK:
            yield low, k + 1
            low, size = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one, as bytes; where each word (as by str.split()) begins and ends there; the number of the first word of each text, and of all words."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" + _PAD, np.uint8)
    kind = _KIND[data]
    kind[-len(_PAD) :] = 1
    lead = np.flatnonzero(kind == 2)
    kind[lead] = 0
    if len(lead):
        a, b, c = data[lead], data[lead + 1], data[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        high = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = high | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        for at in (lead[two], lead[two] + 1, lead[three], lead[three] + 1, lead[three] + 2):
            kind[at] = 1
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    bound = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) + 1)
    return data, start, end, bound


def _lanes(data: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The eight bytes of data that begin at each place, as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).__getitem__


def numbers_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes [start, end) of data for each word, in less time than hashes_of() takes."""
    lane, size = _lanes(data), end - start
    h = _scattered((lane(start) & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _P3)
    for k in range(8, 32, 8):
        i = np.flatnonzero(size > k)
        if len(i):
            h[i] = _scattered(h[i] * _P1 + (lane(start[i] + k) & _MASK[np.minimum(size[i] - k, 8)]))
    for k in np.flatnonzero(size > 32).tolist():
        h[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    return h


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P2
    return x ^ (x >> np.uint64(29))


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxhash.xxh64_intdigest() of the bytes [start, end) of data for each word; data goes on for 32 bytes after the last."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    lane = _lanes(data)
    size = end - start
    h = size.astype(np.uint64) + _P5
    for k in range(3):
        i = np.flatnonzero(size >= 8 * (k + 1))
        if len(i):
            h[i] = turned(h[i] ^ (turned(lane(start[i] + 8 * k) * _P2, 31) * _P1), 27) * _P1 + _P4
    rest = size & 7
    last = lane(np.minimum(end - rest, len(data) - 8))
    i = np.flatnonzero(rest >= 4)
    h[i] = turned(h[i] ^ ((last[i] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    last[i] >>= np.uint64(32)
    rest &= 3
    for k in range(3):
        i = np.flatnonzero(rest > k)
        h[i] = turned(h[i] ^ ((last[i] & np.uint64(255)) * _P5), 11) * _P1
        last[i] >>= np.uint64(8)
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size > 31).tolist():
        h[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    return h


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges [low, high) all numbers, and the range that each is of."""
    size = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(low)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of], of
