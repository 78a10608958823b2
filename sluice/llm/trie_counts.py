"""Token counts of a unigram model, by dynamic programming that pre-tokens of a common prefix share in a trie."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Recent, table

#: A space before anything but white space always starts a match of the usual patterns.
_GAP = re.compile(r" (?=\S)")
CACHE = 300_000
NODES = 1_000_000
MANDELBROT = 2.7


def zipf_scores(ranked: list[bytes]) -> dict[bytes, float]:
    """Log-probabilities by rank alone, after Zipf and Mandelbrot: the vocabulary files carry none, and none are trained."""
    total = sum(1 / (r + MANDELBROT) for r in range(len(ranked)))
    return {token: -math.log((r + MANDELBROT) * total) for r, token in enumerate(ranked)}


class PrefixTrie:
    """Best segmentations of byte strings under a unigram model.

    A node is a prefix of some pre-token. Its forward score, the best log-probability of any segmentation of the prefix, and the tokens of that
    segmentation are computed when the node is made, from the nodes above it; a later pre-token with this prefix uses them.
    Of equal scores the segmentation of fewer tokens counts.
    """

    def __init__(self, scores: dict[bytes, float]):
        # Every end of a token, with the token's score or, where it is none itself, None: a longer end that is missing here ends the search.
        self.ends: dict[bytes, float | None] = {token[i:]: None for token in scores for i in range(len(token))}
        self.ends.update(scores)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.forward, self.tokens = [0.0], [0]
        self.terminal: dict[int, tuple[int, float]] = {}  # by node

    def insert(self, raw: bytes) -> tuple[int, float]:
        """Number of tokens and log-probability of raw, stored by its terminal node."""
        if len(self.forward) > NODES:
            self.clear()
        node, path, ends, forward, tokens = 0, [0], self.ends.get, self.forward, self.tokens
        for end in range(1, len(raw) + 1):
            key = node << 8 | raw[end - 1]
            node = self.child.get(key, 0)
            if not node:
                best, count = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    score = ends(raw[start:end], 0)
                    if score is None:
                        continue
                    if not score:
                        break
                    before = path[start]
                    score, n = forward[before] + score, tokens[before] + 1
                    if score > best or score == best and n < count:
                        best, count = score, n
                if not count:
                    raise ValueError("the vocabulary lacks a byte")
                node = self.child[key] = len(forward)
                forward.append(best)
                tokens.append(count)
            path.append(node)
        found = self.terminal[node] = self.terminal.get(node) or (self.tokens[node], self.forward[node])
        return found


class TextCounter:
    """Counts of texts; stretches that begin at a space are looked up once they are known."""

    def __init__(self, scores: dict[bytes, float], pattern: str):
        self.trie, self.pattern = PrefixTrie(scores), regex.compile(pattern)
        self.pieces = Recent(lambda p: self.trie.insert(p.encode("utf-8", "surrogatepass")), CACHE)
        self.stretches = Recent(self._stretch, CACHE)

    def _stretch(self, text: str) -> tuple[int, int, float]:
        found = list(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return len(found), sum(n for n, _ in found), sum(s for _, s in found)

    def count(self, text: str | None) -> tuple[int, int, float]:
        """Pre-tokens, tokens and log-probability of a whole text."""
        if not text:
            return 0, 0, 0.0
        first, *rest = _GAP.split(text)
        parts = [first] if first else []
        parts += [" " + p for p in rest]
        pieces, tokens, scores = zip(*map(self.stretches.__getitem__, parts), strict=True)
        return sum(pieces), sum(tokens), math.fsum(scores)


@lru_cache(2)
def counter(path: str, pattern: str) -> TextCounter:
    """One for each process."""
    with open(path, "rb") as f:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    return TextCounter(zipf_scores([token for _, token in rows]), pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """keep columns, n_bytes, n_pretokens, n_tokens and log_probability of every whole text; nothing is shuffled.

    Null and empty texts count 0; repeated rows give repeated rows; an empty table gives none.
    """
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_bytes long, n_pretokens long, n_tokens long, log_probability double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path, pattern).count
        for batch in batches:
            found = [count(t) for t in batch["text"]]
            out = batch[list(keep)].copy()
            out["n_bytes"] = [len((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]]
            out["n_pretokens"], out["n_tokens"], out["log_probability"] = [f[0] for f in found], [f[1] for f in found], [round(f[2], 6) for f in found]
            yield out

    return docs.select(*keep, "text").mapInPandas(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the ranked vocabulary of byte_bpe_multi_50k.tiktoken, taken as a unigram model."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id")
