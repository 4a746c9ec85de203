"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the
last return the columns of ``documents``. Every stage takes nulls, empty tables and further columns, as its operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dishlens.config import scratch, work_dir
from dishlens.llm import exact_dedup, mixing, near_dedup, pieces, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words of a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out; documents predicted toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one document stays."""
    return exact_dedup.keep_first(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on runs of five words, the one with the least doc_id stays."""
    return near_dedup.keep_representatives(docs, width=SHINGLE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, lossless and ids of each row."""
    return pieces.tokenized(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the classifier nor the segmentation; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder; what a stage writes on its way is removed when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
