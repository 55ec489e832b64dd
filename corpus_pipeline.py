"""The corpus pipeline: toxic documents out, repeated lines out, near-duplicates out, benchmark leaks out, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it back from Parquet. All but the last
return the columns of ``documents``; the last one adds the ids of each text and keeps the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.llm import bpe, decontaminate, linededup, probminhash, toxicity
from weirworks.llm.common import table
from weirworks.session import scratch_path

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as it is for the texts at hand."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linededup.dedup_lines(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the text as decoded from its ids, and the ids."""
    return bpe.with_ids(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The stages on models, estimates and tokens have no SQL form; the tests run each stage against a brute-force one.
ORACLE_SQL = None
