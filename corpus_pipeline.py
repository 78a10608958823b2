"""From raw documents to a training mix, in stages that each write their documents for the next.

Every stage takes empty tables, null and empty texts, null and repeated ids, and further columns of any name, which it keeps; what becomes of them is said below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import byte_bpe, mixing, passages, quality, simhash
from sluice.llm.common import drop_scratch, table, written


def small_batches(spark: SparkSession) -> None:
    """Texts are long: fewer of them go to a Python worker at once. The setting is read when a stage's result is written, so it stays in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labels, accepts. A row stays or goes by its own text, null and empty ones too, so repeated ids need no care. Without any label every row stays."""
    small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles): that of the least doc_id. Null and empty texts are one group; rows without a doc_id stay; of equal rows one stays, of rows that share an id alone each is judged by its text."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows. A document of nothing else goes; rows without a doc_id or text stay as they are."""
    small_batches(spark)
    return passages.drop_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the words taken over its size, a part of a copy counting as one. Null and empty texts go; of rows equal in id, source and text one stands for all."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document of the mix; null and empty texts have none, repeated rows repeated rows."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN, "doc_id", "source")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", no_near_copies),
    ("substring dedup", no_repeated_passages),
    ("source mix", mixed),
    ("byte-level BPE", tokens),
]
#: Models and fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the mix of sf_dir's documents. Each stage's documents are deleted once the next stage's are written."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, before, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            drop_scratch(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
