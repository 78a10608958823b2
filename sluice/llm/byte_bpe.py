"""Byte-level BPE by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Recent, table

#: A space before anything but white space always starts a match of the usual patterns.
_GAP = re.compile(r" (?=\S)")
CACHE = 400_000
#: Prefixes that stay stored with their last tokens.
NODES = 1_000_000
#: Pieces of more bytes are encoded without storing their prefixes.
LONG = 512


class PrefixBPE:
    """BPE by ranks. For each prefix of a byte string the last token of its encoding is unique, so an array of last tokens holds the encodings of all prefixes.

    A token may end a prefix if it is compatible with the last token of what stands before it, that is, if merging
    their bytes together by rank gives just those two. Appending bytes extends the array and changes none of it.
    """

    def __init__(self, ranks: dict[bytes, int], nodes: int = NODES):
        self.ranks, self.nodes = ranks, nodes
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, bool], tuple[tuple[int, float], ...]] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._children: dict[int, int] = {}  # prefix number * 256 + byte: the longer prefix's number
        self._last: list[int] = [-1]

    # -- which tokens stand side by side

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or for a token that no merges make."""
        if token not in self._halves:
            raw, found = self.bytes_of[token], None
            if len(raw) > 1:
                parts = self._walk(raw, self._extend(raw, [], below=token))
                found = (parts[0], parts[1]) if parts and len(parts) == 2 else None
            self._halves[token] = found
        return self._halves[token]

    def made(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = len(self.bytes_of[token]) == 1 or self.halves(token) is not None
        return known

    def _spine(self, token: int, right: bool) -> tuple[tuple[int, float], ...]:
        """The token's outermost parts on one side, smallest first, each with the rank at which it is merged away."""
        chain = self._spines.get((token, right))
        if chain is None:
            up, part, parent = [], token, float("inf")
            while part >= 0:
                up.append((part, parent))
                parts = self.halves(part)
                parent, part = part, (parts[1 if right else 0] if parts else -1)
            chain = self._spines[token, right] = tuple(reversed(up))
        return chain

    def fits(self, a: int, b: int) -> bool:
        """Whether a then b is what their bytes together encode to."""
        pair = a << 32 | b
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > CACHE:
                self._fits.clear()
            known = self._fits[pair] = self._stand(a, b, float("inf"))
        return known

    def _stand(self, a: int, b: int, below: float) -> bool:
        """Whether a and b stay side by side under the merges of rank less than below.

        Merges happen in the order of ranks, and of equal ones the leftmost first. So the parts that face each other are followed
        upwards from single bytes: they merge across if that rank comes before the left part's next merge and not after the right's.
        """
        left, right, i, j = self._spine(a, True), self._spine(b, False), 0, 0
        while True:
            (x, x_next), (y, y_next) = left[i], right[j]
            across = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if across is not None and across < below and across < x_next and across <= y_next:
                return False
            if x_next == y_next == float("inf"):
                return True
            if x_next <= y_next:
                i += 1
            else:
                j += 1

    # -- prefixes

    def _extend(self, raw: bytes, last: list[int], below: int | None = None, upto: int | None = None) -> list[int]:
        """last, carried on to the end of raw, or to upto; -1 where no token fits. below leaves out tokens of that rank or more."""
        ranks, longest = self.ranks, self.longest
        for end in range(len(last) + 1, (len(raw) if upto is None else upto) + 1):
            found = -1
            for start in range(max(0, end - longest), end):
                token = ranks.get(raw[start:end])
                if token is None or (below is not None and token >= below) or (start and last[start - 1] < 0):
                    continue
                if self.made(token) and (start == 0 or (self.fits(last[start - 1], token) if below is None else self._stand(last[start - 1], token, below))):
                    found = token  # the first that fits is the only one
                    break
            last.append(found)
        return last

    def _walk(self, raw: bytes, last: list[int], end: int | None = None) -> list[int] | None:
        """Tokens of the prefix that ends at end, from its last token backwards."""
        out, at = [], len(raw) if end is None else end
        while at:
            token = last[at - 1]
            if token < 0:
                return None
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def prefixes(self, raw: bytes) -> list[int]:
        """The last token of each prefix's encoding."""
        return self._extend(raw, [])

    def append(self, raw: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The bytes with more at their end, and their prefixes' last tokens; what was there is kept."""
        raw = raw + more
        return raw, self._extend(raw, list(last))

    def replace(self, raw: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """raw with new in place of [start, end). Prefixes before the edit stay; the rest is computed until last tokens agree with the old ones for a token's length."""
        edited, shift = raw[:start] + new + raw[end:], len(new) - (end - start)
        fresh, same = last[:start], 0
        for at in range(start, len(edited)):
            self._extend(edited, fresh, upto=at + 1)
            old = at - shift
            # A prefix's last token depends on the last tokens of a token's length before it, and on the bytes there.
            same = same + 1 if at >= start + len(new) + self.longest and 0 <= old < len(last) and last[old] == fresh[-1] else 0
            if same >= self.longest:
                return edited, fresh + last[old + 1 :]
        return edited, fresh

    def forget(self) -> None:
        self._children, self._last = {}, [-1]
        self._fits.clear()

    def encode_piece(self, raw: bytes) -> list[int]:
        """Tokens of a piece: itself if it is a token, else the walk back from its last prefix. Prefixes are stored, so pieces that begin alike append to what is known."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) > LONG:
            out = self._walk(raw, self._extend(raw, []))
            if out is None:
                raise ValueError("the vocabulary lacks single bytes")
            return out
        if len(self._last) > self.nodes:
            self.forget()
        children, stored, last, at = self._children, self._last, [], 0
        for end, byte in enumerate(raw, 1):
            number = children.get(at << 8 | byte)
            if number is None:
                self._extend(raw, last, upto=end)
                number = children[at << 8 | byte] = len(stored)
                stored.append(last[-1])
            else:
                last.append(stored[number])
            at = number
        out = self._walk(raw, last)
        if out is None:
            raise ValueError("the vocabulary lacks single bytes")
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextBPE:
    """Encodes texts piece by piece; stretches between spaces, and pieces, that were seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, nodes: int = NODES, known: int = CACHE):
        self.bpe, self.pattern = PrefixBPE(ranks, nodes), regex.compile(pattern)
        self.known = Recent(self._joined, known)

    def _joined(self, stretch: str) -> str:
        """Ids of a stretch of text; a piece by itself matches as it does in a text, so stretches and pieces share what is known."""
        pieces = self.pattern.findall(stretch)
        if len(pieces) == 1:
            return ",".join(map(str, self.bpe.encode_piece(stretch.encode("utf-8"))))
        return ",".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str | None) -> tuple[int, str]:
        """Number of tokens, and their ids in decimal, joined by commas."""
        if not text:
            return 0, ""
        first, *rest = _GAP.split(text)
        parts = [first] if first else []
        parts += [" " + p for p in rest]
        joined = ",".join(map(self.known.__getitem__, parts))
        return joined.count(",") + 1, joined

    def forget(self) -> None:
        self.known.clear()
        self.known.older = {}
        self.bpe.forget()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids))


@lru_cache(2)
def encoder(path: str, pattern: str, nodes: int = NODES, known: int = CACHE) -> TextBPE:
    """One for each process: what it has seen serves all tasks that run there."""
    return TextBPE(load_ranks(path), pattern, nodes, known)


def encode(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """keep columns, n_tokens and ids (array<int>) of each whole text. Null and empty texts have none; repeated rows give repeated rows; other columns go."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_tokens long, ids array<int>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern, NODES // 4, CACHE // 4)  # other stages run in the same workers: about a third of the memory
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                out = part[list(keep)].copy()
                found = [bpe.encode(t) for t in part["text"]]
                out["n_tokens"] = [n for n, _ in found]
                out["ids"] = [[int(i) for i in s.split(",")] if s else [] for _, s in found]
                yield out
        bpe.forget()  # the worker may go on with something else

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """keep columns, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the bytes the ids decode to)."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        by_name = {str(i): b for i, b in bpe.bpe.bytes_of.items()}
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch["text"]:
                n, joined = bpe.encode(text)
                counts.append(n)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded = b"".join(map(by_name.__getitem__, joined.split(","))) if joined else b""
                texts.append(hashlib.sha256(decoded).hexdigest())
            out = batch[list(keep)].copy()
            out["n_tokens"], out["ids_sha256"], out["decoded_sha256"] = counts, ids, texts
            yield out

    return docs.select(*keep, "text").mapInPandas(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no token; repeated rows give repeated rows; an empty table gives none."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id")
