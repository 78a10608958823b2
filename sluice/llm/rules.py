"""Quality rules: statistics of texts, and decision lists over them that are learnt from labels by sequential covering.

Statistics, bins, the table of labelled cells and the verdicts are DataFrame operations alone. The learner sees one bounded table of counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, settled, table, written

SYMBOL = "[#*$%&|<>]"
WINDOW = 8
#: Rows of labels from which a list is learnt at most; from larger tables a share is taken by a hash of doc_id.
MOST_LABELS = 200_000
#: Thresholds tried of each statistic: its quantiles, in so many steps, among the good and among the bad labelled rows.
CUTS = 32
#: What a rule's precision on rows that it did not grow on is at least.
PRUNED = 0.8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions are on. Shares do not grow with a text.
SHARES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
}


# ---------------------------------------------------------------- statistics


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _found_twice(keyed: Column) -> Column:
    """The positions, in order, of the structs (key, pos) of an array whose key occurs twice or more."""

    def among(s: Column) -> Column:
        n, no = F.size(s) - 1, F.array(F.lit(False))
        same = F.zip_with(F.slice(s, 1, F.greatest(n, F.lit(0))), F.slice(s, 2, F.greatest(n, F.lit(0))), lambda a, b: a["key"] == b["key"])
        return _let(same, lambda f: F.zip_with(s, F.zip_with(F.concat(f, no), F.concat(no, f), lambda a, b: a | b), lambda k, twice: F.when(twice, k["pos"])))

    return F.sort_array(F.filter(_let(F.sort_array(keyed), among), lambda p: p.isNotNull()))


def _reach(starts: Column) -> Column:
    """How many words runs of WINDOW words with those starts, in order, have together."""
    n = F.greatest(F.size(starts) - 1, F.lit(0))
    own = F.zip_with(F.slice(starts, 1, n), F.slice(starts, 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(own, F.least(F.size(starts), F.lit(1)) * WINDOW, lambda total, x: total + x).cast("long")


def run_hashes(words: Column) -> Column:
    """A hash of each run of WINDOW of an array's words."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))
    return F.transform(heads, lambda w, i: F.xxhash64(w, *[words[i + k] for k in range(1, WINDOW)]))


def repeated_words(words: Column, runs: Column) -> Column:
    """How many of an array's words lie in a run of WINDOW words that occurs twice or more in it, by their run_hashes().

    Only arrays in which a hash comes twice are sorted, and only their runs whose hash does are compared as words.
    """
    near = _found_twice(F.transform(runs, lambda x, i: F.struct(x.alias("key"), i.alias("pos"))))
    exact = _found_twice(F.transform(near, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("key"), i.alias("pos"))))
    return F.when(F.size(F.array_distinct(runs)) < F.size(runs), _let(exact, _reach)).otherwise(F.lit(0).cast("long"))


def words_between_spaces(text: Column) -> Column:
    """The words of a text: other white space becomes spaces, which split fastest."""
    for space in "\t\n\v\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs (not named as a statistic) and the statistics of its text, longs: COUNTS, and n_lines (with a word), n_capitals and n_marks
    (punctuation but for full stops and commas). Null is as empty, all zero. A text's words are in memory, one text at a time in a task.
    """
    counted = {"n_symbols": SYMBOL, "n_capitals": r"\p{Lu}", "n_marks": r"[\p{P}&&[^.,]]"}
    found = {name: F.regexp_count("text", F.lit(pattern)).cast("long") for name, pattern in counted.items()}
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select(*keep, words_between_spaces(F.col("text")).alias("split"), lines.alias("lines"), *[c.alias(n) for n, c in found.items()])
    rows = rows.withColumns({
        "n_words": F.size("split").cast("long"),
        "word_chars": F.length(F.array_join("split", "")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "runs": run_hashes(F.col("split")),
    })
    return rows.withColumn("n_repeat_words", repeated_words(F.col("split"), F.col("runs"))).select(*keep, *COUNTS, "n_lines", "n_capitals", "n_marks")


def base_failed() -> Column:
    """Too few words, or over 30 in 100 of them in repeated runs."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# ---------------------------------------------------------------- decision lists


@dataclass(frozen=True)
class Condition:
    share: str
    above: bool  # at or above the threshold, or else below it
    threshold: float

    def column(self) -> Column:
        value = F.expr(SHARES[self.share])
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.share} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejected: int  # labelled rows that it takes, bad and good
    wrongly: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out &= c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def verdict(rules: list[Rule]) -> Column:
    """Whether a row of statistics() stays: false at the first rule that holds, true if none does."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def _precision(bad: float, good: float) -> float:
    return bad / (bad + good) if bad + good else 0.0


def _grown(bins: np.ndarray, bad: np.ndarray, good: np.ndarray, cuts: list[list[float]], most: int) -> list[tuple[int, int, bool]]:
    """Conditions (share, cut, above), each the one with the most information on the bad rows (FOIL's gain) among those that are left."""
    held, out = np.ones(len(bins), bool), []
    while len(out) < most and good[held].sum() > 0:
        p0, best = _precision(bad[held].sum(), good[held].sum()), (1e-9, None)
        for share, thresholds in enumerate(cuts):
            m = len(thresholds) + 1
            b, g = (np.bincount(bins[held, share], weights=x[held], minlength=m) for x in (bad, good))
            below_b, below_g = np.cumsum(b)[:-1], np.cumsum(g)[:-1]
            for above, pb, pg in ((True, b.sum() - below_b, g.sum() - below_g), (False, below_b, below_g)):
                ratio = np.divide(pb, pb + pg, out=np.zeros(len(pb)), where=pb + pg > 0)
                gain = np.where(pb > 0, pb * (np.log2(np.maximum(ratio, 1e-12)) - np.log2(p0)), -1.0)
                if len(gain) and gain.max() > best[0]:
                    best = gain.max(), (share, int(gain.argmax()), above)
        if best[1] is None:
            break
        out.append(best[1])
        held &= _holds(bins, out[-1])
    return out


def _holds(bins: np.ndarray, condition: tuple[int, int, bool]) -> np.ndarray:
    share, cut, above = condition
    return (bins[:, share] > cut) == above


def learn(cells: np.ndarray, counts: np.ndarray, cuts: list[list[float]], least: int = 4, precision: float = 0.95, most_conditions: int = 4, most_rules: int = 32) -> list[Rule]:
    """A decision list for rejection from cells (a row of bins for each, bin k being at or above k of the cuts of its share) and counts (grow good, grow bad, prune good, prune bad).

    Sequential covering: a rule grows on the growing rows that no rule takes yet; conditions are cut off from its end where that is better on the
    pruning rows ((bad - good) / (bad + good)); it joins the list if both parts together give it least bad rows and that precision, and the
    pruning rows alone a precision of PRUNED. The first rule that falls short ends the list.
    """
    left, rules = np.ones(len(cells), bool), []
    while len(rules) < most_rules:
        good, bad, pgood, pbad = (counts[:, k] * left for k in range(4))
        if bad.sum() == 0:
            break
        grown = _grown(cells, bad, good, cuts, most_conditions)
        if not grown:
            break
        held, worth = np.ones(len(cells), bool), []
        for condition in grown:
            held = held & _holds(cells, condition)
            b, g = pbad[held].sum(), pgood[held].sum()
            worth.append((b - g) / (b + g) if b + g else -1.0)
        grown = grown[: int(np.argmax(worth)) + 1]
        held = np.logical_and.reduce([_holds(cells, c) for c in grown])
        b, g = pbad[held].sum(), pgood[held].sum()
        every_b, every_g = b + bad[held].sum(), g + good[held].sum()
        if every_b < least or _precision(every_b, every_g) < precision or _precision(b, g) < PRUNED:
            break
        names = list(SHARES)
        rules.append(Rule(tuple(Condition(names[s], above, cuts[s][cut]) for s, cut, above in grown), int(every_b), int(every_g)))
        left &= ~held
    return rules


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """doc_id and bad of labels (doc_id, quality; one row each, nulls left out) without the held-out ones; of more than about most rows a share by a hash of doc_id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).alias("bad"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = known.count()
    if rows <= most:
        return known
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1_000_000)) < int(1_000_000 * most / rows))


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of cuts value is at or above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= value))


def fit(rows: DataFrame, labels: DataFrame, most: int = MOST_LABELS, **options) -> list[Rule]:
    """The decision list from the labelled ones of rows (doc_id and statistics()) that pass the base rule, about most of them; options go to learn().

    Of rows that share a doc_id one counts. The labels that are looked for are at most about most rows and are broadcast; what comes to the driver is a row of
    counts for each filled cell, at most one for each labelled row. A third of the rows, by a hash, is for pruning. Without labels of both kinds there is no rule.
    """
    shares = F.struct(base_failed().alias("failed"), *[F.expr(e).cast("double").alias(n) for n, e in SHARES.items()])
    some = rows.join(F.broadcast(labelled_sample(labels, most)), "doc_id").groupBy("doc_id", "bad").agg(F.min(shares).alias("row"))
    some = written(some, "labelled").where("not row.failed").select("doc_id", "bad", "row.*")
    quantiles = [k / CUTS for k in range(CUTS + 1)]
    found = some.groupBy("bad").agg(*[F.percentile_approx(n, quantiles, 10_000).alias(n) for n in SHARES]).collect()
    if len(found) < 2:
        return []
    cuts = [sorted({t for kind in found for t in kind[n]}) for n in SHARES]
    at = [_bin(F.col(n), c).alias(n) for n, c in zip(SHARES, cuts, strict=True)]
    part = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, 2).otherwise(0) + F.col("bad").cast("int")
    cells = some.select(*at, part.alias("part")).groupBy(*SHARES).agg(*[F.count_if(F.col("part") == k).alias(f"c{k}") for k in range(4)]).collect()
    counts = np.array([list(r) for r in cells], dtype=np.int64)
    counts = counts[np.lexsort(counts.T)]
    return learn(counts[:, : len(SHARES)], counts[:, len(SHARES) :].astype(float), cuts, **options)


@settled("judged")
def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of each row of docs (doc_id, text; others are passed over). kept is the learnt list's verdict where the base rule does not fail.

    Statistics are computed once: the list is learnt from those of labelled rows. A row stands by its own text: repeated rows give repeated rows, a null doc_id stays, null and
    empty texts fail the base rule. An empty table gives none, and without labels the base rule alone decides.
    """
    rows = written(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "statistics")
    rules = fit(rows, labels, **options)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept")
