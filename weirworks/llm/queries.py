"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weirworks.llm import bestposition, bpe, covertree, decontaminate, langid, linededup, probminhash, resample, rollups, shards, toxicity, trielm, warc
from weirworks.llm.common import table
from weirworks.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_token_shards")
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    sequences = shards.write_shards(table(spark, sf_dir, "documents"), path, BYTE_RANKS, public_tokenizers.PATTERN)
    return shards.with_numbers(shards.read_shards(spark, path, sequences), sequences)


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates first; then one batch that revises them, adds a second tokenizer and deletes the estimates' own version."""
    docs = table(spark, sf_dir, "documents")
    estimate = docs.select("doc_id", F.explode(F.array(F.lit("byte_bpe_50k"), F.lit("characters_by_4"))).alias("version"), "source", "lang",
                           F.ceil(F.coalesce("n_chars", F.lit(0)) / 4).cast("long").alias("n_tokens"))
    gone = docs.select("doc_id", F.lit("characters_by_4").alias("version"), "source", "lang", F.lit(None).cast("long").alias("n_tokens"))
    versions = {"byte_bpe_50k": BYTE_RANKS, "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    counted = rollups.token_counts(docs, versions, public_tokenizers.PATTERN)
    totals = rollups.TokenRollup(spark, scratch_path(spark, "rollup"))
    totals.apply(1, estimate)
    totals.apply(2, counted.unionByName(gone))
    return totals.totals()


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query("op5_prob_minhash")
def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


@query("op7_warc_archive", warc.SQL)
def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.parsed(warc.read_archive(spark, path))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_line_dedup", linededup.SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(table(spark, sf_dir, "documents"))


@query("op10_cover_tree_top_k", covertree.SQL)
def op10_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op11_trie_scores")
def op11_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trielm.score_texts(table(spark, sf_dir, "documents"))


@query("op12_target_resample")
def op12_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_best_position_search", bestposition.SQL)
def op13_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestposition.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """(queries, SQL) of this subpackage."""
    return dict(QUERIES), dict(ORACLES)
