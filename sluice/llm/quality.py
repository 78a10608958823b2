"""Quality scores: kernel ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, table, written

FEATURES = 256
RIDGE = 1e-3
SEED = 20240101
BINS = 4096
#: At most about this many labelled rows are fitted; which ones, a hash of their statistics decides.
MOST_LABELLED = 2_000_000
ACCEPT = 0.7

_PUNCTUATION = np.frombuffer(bytes(b for b in range(33, 127) if not chr(b).isalnum()), np.uint8)
_SENTENCE = np.frombuffer(b".,;:?!'\"-()", np.uint8)
_SYMBOL = np.setdiff1d(_PUNCTUATION, _SENTENCE)


# ---------------------------------------------------------------- document statistics


def statistics(text: str | None) -> list[float]:
    """Bounded statistics of a whole text; an empty or null text has zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATISTICS
    lines = [x for x in text.split("\n") if x.strip()]
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = int(byte.sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    pairs = len(set(zip(words, words[1:], strict=False)))
    upper = sum(map(str.isupper, words))
    shout = byte[33]
    return [
        math.log1p(n) / 10,
        min(float(lengths.mean()), 30.0) / 10,
        min(float(lengths.std()), 30.0) / 10,
        min(float(lengths.max()), 200.0) / 100,
        upper / n,
        sum(map(str.istitle, words)) / n,
        len(counts) / n,
        top / n,
        pairs / max(n - 1, 1),
        sum(map(operator.eq, words, words[1:])) / n,
        byte[65:91].sum() / size,
        byte[48:58].sum() / size,
        byte[_SENTENCE].sum() / size,
        byte[_SYMBOL].sum() / size,
        min(byte[_SYMBOL].sum() / n, 3.0),
        min(shout / n, 3.0),
        byte[46] / n if n else 0.0,
        byte[44] / n if n else 0.0,
        byte[124] / n,
        byte[128:].sum() / size,
        len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)) / 5,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(len(lines), 1),
        math.log1p(sum(map(str.isalpha, words))) / 10,
    ]


N_STATISTICS = 24


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns and stats (array<double>) of each whole text."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "stats array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keep)].copy()
            out["stats"] = [np.asarray(statistics(t), np.float64) for t in batch["text"]]
            yield out

    return docs.select(*keep, "text").mapInPandas(run, schema)


# ---------------------------------------------------------------- the model


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray  # statistics x FEATURES: frequencies of the Gaussian kernel
    phase: np.ndarray
    weights: np.ndarray  # FEATURES + 1, the last one constant
    steps: np.ndarray  # raw scores and
    levels: np.ndarray  # the shares of label 1 there, never falling

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale, self.omega, self.phase) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.levels), 0.0, 1.0)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.sqrt(2.0 / omega.shape[1]) * np.cos(np.clip((stats - mean) / scale, -8, 8) @ omega + phase)
    return np.hstack([z, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of x (n rows, ones of label 1 each): the means of x and the levels of the pools."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, n, ones, strict=True):
        pools.append([a * b, b, c])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """Element-wise sum over all rows of the fixed-size vectors that make() yields once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += make(np.stack(batch["stats"].to_numpy()), batch["y"].to_numpy(np.float64))
        yield pd.DataFrame({"at": np.arange(0, size, 256), "part": [total[i : i + 256] for i in range(0, size, 256)]})

    sums = rows.select("stats", "y").mapInPandas(run, "at int, part array<double>")
    sums = sums.select("at", F.posexplode("part").alias("i", "x")).groupBy((F.col("at") + F.col("i")).alias("k")).agg(F.sum("x").alias("x"))
    got = sums.toPandas()  # size numbers, whatever the number of rows
    out = np.zeros(size)
    out[got["k"].to_numpy()] = got["x"].to_numpy()
    return out


def fit(labelled: DataFrame, fold: Column, most: int = MOST_LABELLED, seed: int = SEED) -> Model | None:
    """A model from labelled (stats, y of 0 or 1); rows where fold is true calibrate it and the rest fit it.

    Each task adds up its part of the normal equations, a matrix of fixed size, and the driver solves their
    sum. Isotonic calibration goes over at most BINS bins of raw scores. Above most labelled rows a hash
    of their statistics keeps about that many. None where nothing is labelled.
    """
    n = labelled.count()
    if not n:
        return None
    if n > most:
        labelled = labelled.where(F.pmod(F.xxhash64("stats"), F.lit(1_000_000)) < int(1e6 * most / n))
    parts = max(8, min(n, most) // 50_000)
    rows = written(labelled.select("stats", F.col("y").cast("double").alias("y"), fold.alias("fold")).repartition(parts), "labelled")
    d = N_STATISTICS
    s = _summed(rows, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]), 2 * d + 1)
    mean = s[:d] / s[-1]
    scale = np.sqrt(np.maximum(s[d : 2 * d] / s[-1] - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    omega, phase = rng.standard_normal((d, FEATURES)) / math.sqrt(d), rng.uniform(0, 2 * math.pi, FEATURES)
    width = FEATURES + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x, mean, scale, omega, phase)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(z)]])

    fitting = rows.where("not fold")
    s = _summed(fitting, equations, width * width + width + 1)
    if not s[-1]:
        s = _summed(rows, equations, width * width + width + 1)
    weights = np.linalg.solve(s[: width * width].reshape(width, width) + RIDGE * s[-1] / width * np.eye(width), s[width * width : -1])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = fourier(x, mean, scale, omega, phase) @ weights
        at = np.clip(((raw + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    s = _summed(rows.where("fold"), binned, 3 * BINS)
    if not s[:BINS].sum():
        s = _summed(rows, binned, 3 * BINS)
    drop_scratch(rows)
    full = s[:BINS] > 0
    count = s[:BINS][full]
    steps, levels = isotonic(s[2 * BINS :][full] / count, count, s[BINS : 2 * BINS][full])
    return Model(mean, scale, omega, phase, weights, steps, levels)


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """stats without its column stats, with score; one half where there is no model."""
    keep = [c for c in stats.columns if c != "stats"]
    if model is None:
        return stats.select(*keep, F.lit(0.5).alias("score"))
    schema = ", ".join([*(f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in keep), "score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].copy()
            out["score"] = model.score(np.stack(batch["stats"].to_numpy())) if len(batch) else np.zeros(0)
            yield out

    return stats.mapInPandas(run, schema)


def learnt(stats: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model | None:
    """A model from stats (doc_id, stats) and labels (doc_id, quality), of which those are used where learn holds."""
    use = labels.where("quality is not null").select("doc_id", (F.col("quality") > 0).cast("int").alias("y"))
    if learn is not None:
        use = use.where(learn)
    return fit(stats.join(use, "doc_id").select("doc_id", "stats", "y"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """docs' doc_id and score (0 to 1; higher: label 1 is likelier), learnt from labels (doc_id, quality) where learn holds.

    Scores see the statistics of the text alone. Null and empty texts have zeros for statistics and a score like any
    other; repeated rows give repeated rows; a null doc_id is scored and never learnt from; labels of no
    document, or of null quality, are ignored; of several labels of a document each counts. Without any label scores are 0.5.
    """
    stats = written(with_statistics(docs.select("doc_id", "text"), "doc_id"), "stats")
    return scored(stats, learnt(stats, labels, learn))


def accepted(docs: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The rows of docs that score least or more under a model of all labels; every row if there are none. Texts are not shuffled."""
    stats = written(with_statistics(docs.select("doc_id", "text"), "doc_id"), "stats")
    model = learnt(stats, labels)
    drop_scratch(stats)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in text]).reshape(-1, N_STATISTICS)))

    return docs.where(score("text") >= least)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_scores(docs, labels, fold_of(F.col("doc_id")) != 2)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
