"""The registered corpus queries on whole small tables: SQL where there is some, else brute force; and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as contract
import corpus_pipeline
from test_lines_warc import brute_lines
from test_near import brute_classes
from test_search_leaks import brute_leaks
from tools.check_queries import compare, connect
from weirworks.llm import bpe, decontaminate
from weirworks.llm.queries import load

QUERIES, ORACLES = load()


def library(name):
    ranks = bpe.load_ranks(public_tokenizers.path(name))
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline"} == set(range(1, 14)) and "pipeline" in QUERIES
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    ok, message, _ = compare(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir)
    assert ok, message


def test_leaks(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = sorted(map(tuple, QUERIES["op1_decontamination"](spark, sf_dir).collect()), key=str)
    some = [(d.doc_id, d.text) for d in docs if d.doc_id in {r[0] for r in found} or d.doc_id < 6]
    assert found and found == brute_leaks(some, items, decontaminate.LeakRules())
    plain = {(d.doc_id, i) for d in docs for i, text in items if decontaminate.normal(text) in decontaminate.normal(d.text)}
    assert plain == {r[:2] for r in found if r[2] == 0}


def test_shards_hold_the_corpus(spark, sf_dir, docs):
    rows = QUERIES["op2_token_shards"](spark, sf_dir).collect()
    code = library("byte_bpe_50k.tiktoken")
    total = sum(len(code.encode_ordinary(d.text or "")) + 1 for d in docs)
    assert sorted(r.slot for r in rows) == list(range(-(-total // 1024))) == sorted(r.sequence for r in rows)


def test_token_counts(spark, sf_dir, docs):
    wanted = {}
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        code = library(f"{version}.tiktoken")
        for d in docs:
            n, tokens = wanted.get((d.source, d.lang, version), (0, 0))
            wanted[d.source, d.lang, version] = (n + 1, tokens + len(code.encode_ordinary(d.text or "")))
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()} == wanted


def test_near_classes(spark, sf_dir, docs):
    got = {r.doc_id: r.class_id for r in QUERIES["op5_prob_minhash"](spark, sf_dir).collect()}
    assert got == brute_classes([(d.doc_id, d.text) for d in docs])


def test_pipeline_stage_by_stage(spark, sf_dir, docs, tmp_path):
    table, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), docs[0].__fields__
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in table.collect()}
        stage(spark, table, sf_dir).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        after = kept[name] = {r.doc_id: r for r in table.collect()}
        assert table.count() == len(after) and table.columns[: len(columns)] == columns
        same = [(i, before[i].text) for i in sorted(before)]
        if name == "toxicity":
            assert all(i in after for i in before if labels.get(i) == 0)
            english = [i for i in before if labels.get(i) == 1 and before[i].lang == "en"]
            assert sum(i in after for i in english) <= 0.2 * len(english)
        elif name == "line_dedup":
            assert sorted((i, hashlib.sha256(r.text.encode()).hexdigest()) for i, r in after.items()) == sorted((r[0], r[3]) for r in brute_lines(same))
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert sorted(after) == sorted(set(brute_classes(same).values()))
        elif name == "decontamination":
            gone = {d for d, text in same for _, item in items if decontaminate.normal(item) in decontaminate.normal(text)}
            assert set(before) - set(after) >= gone
        elif name == "byte_bpe":
            code = library("byte_bpe_50k.tiktoken")
            assert all(r.text == before[i].text and r.token_ids == code.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) for i, r in after.items())
    sizes = Counter({name: len(rows) for name, rows in kept.items()})
    assert 0 < sizes["byte_bpe"] == sizes["decontamination"] <= sizes["near_dedup"] <= sizes["line_dedup"] == sizes["toxicity"] < len(docs)
    assert np.mean([len(r.token_ids) for r in kept["byte_bpe"].values()]) > 10
