"""From raw documents to packed training sequences, each stage over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of ``documents``, and
from the last stage the placed pieces. Stages are written down one by one, so a lost executor
never costs more than a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm import language, nearcopies, packing, repeats, toxicity
from sorrel.llm.common import read_table
from sorrel.session import scratch_path

#: Bytes or words of a passage that counts as repeated: over 50 words, or 400 bytes of fewer.
PASSAGE_BYTES, PASSAGE_WORDS = 400, 51
#: Tokens of a training sequence.
SEQUENCE_TOKENS = 1024
#: Rows of a batch that goes to a Python worker: long texts come together, and workers share their executor's memory.
BATCH_ROWS = "1000"


def _sized(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the limit go; the model learns from ``labels``."""
    _sized(spark)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as no language of the corpus go."""
    _sized(spark)
    return language.keep_identified(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word Jaccard 0.8 or SimHash within 3 bits, the smallest id stays."""
    _sized(spark)
    return nearcopies.drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut from the texts; all documents stay."""
    _sized(spark)
    cut = repeats.remove_repeats(docs, PASSAGE_BYTES, words=PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of bounded tokens, segments and loss-bearing tokens."""
    _sized(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("language_id", in_a_language),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("packing", packed),
]

#: Model fits, linking and packing cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
