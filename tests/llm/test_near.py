"""Near-duplicate classes against all pairs, on natural rows, odd rows and crowded buckets."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirworks.llm import probminhash as near
from weirworks.llm.components import components


def brute_similarity(a, b):
    x, y = (dict(zip(*(part.tolist() for part in f), strict=True)) for f in (a, b))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def brute_classes(rows, rules=near.NearRules()):
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    features = [(d, t or "", near.weighted(t or "", rules.words)) for d, t in rows if d is not None]
    for (a, s, f), (b, t, g) in combinations(features, 2):
        if s == t or near.probability_jaccard(f, g) >= rules.threshold:
            union(a, b)
    return {d: find(d) for d in ids}


def test_similarity_forms_agree():
    rng, parts = np.random.default_rng(0), []
    for _ in range(40):
        values = np.unique(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64))
        parts.append((values, rng.integers(1, 4, len(values))))
    block = near.Block(parts)
    for a in parts[:8]:
        many = block.similarities(a, np.ones(len(parts), dtype=bool))
        for b, value in zip(parts, many, strict=True):
            assert value == pytest.approx(brute_similarity(a, b)) == pytest.approx(near.probability_jaccard(a, b))


def test_registers_estimate_the_similarity():
    rng, parts = np.random.default_rng(1), []
    for _ in range(30):
        values = np.unique(rng.integers(0, 60, rng.integers(1, 90)).astype(np.uint64) * np.uint64(2654435761))
        parts.append((values, rng.integers(1, 5, len(values))))
    sizes = [len(p[0]) for p in parts]
    rows = near.signatures(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float), np.repeat(np.arange(30), sizes), 30, 1024)
    errors = [(rows[i] == rows[j]).mean() - near.probability_jaccard(parts[i], parts[j]) for i, j in combinations(range(30), 2)]
    assert np.abs(errors).max() < 0.08 and abs(np.mean(errors)) < 0.005
    alone = near.signatures(parts[3][0], parts[3][1].astype(float), np.zeros(sizes[3], dtype=int), 1, 1024)
    assert (alone[0] == rows[3]).all()


def crowd():
    """A group of near copies around a centre, edited more and less, so that buckets stay divided."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(220)]
    rows = []
    for i in range(60):
        own = list(words)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 14])):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("small_bucket", [64, 3])
def test_classes_match_all_pairs(spark, sf_dir, small_bucket):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    rows = [(r.doc_id + 10_000, r.text) for r in docs.collect()] + crowd()
    rows += [(1, None), (2, ""), (3, "..."), (4, "..."), (5, "one two"), (6, "One, two!"), (7, "long " * 20_000), (8, "long " * 20_001), (5, "one two"), (None, "one two")]
    table = spark.createDataFrame([(*r, "p", "k", "r") for r in rows], "doc_id long, text string, pivot string, key string, root string")
    rules = near.NearRules(small_bucket=small_bucket, block=16)
    got = near.near_classes(table, rules).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.class_id] += 1
    assert len(got) == len({r.doc_id for r in got}) and all(r.class_size == sizes[r.class_id] and r.is_kept == (r.doc_id == r.class_id) for r in got)


def test_one_of_each_class_stays(spark):
    rows = [(9, "a b c d e f g h", 1), (2, "a b c d e f g h", 2), (2, "a b c d e f g h", 3), (5, "other words are here now", 4), (None, "a b c d e f g h", 5)]
    kept = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _gone int"))
    assert kept.columns == ["doc_id", "text", "_gone"]
    assert sorted((r.doc_id, r._gone) for r in kept.collect() if r.doc_id is not None) == [(2, 2), (2, 3), (5, 4)] and kept.count() == 4
    assert near.near_classes(kept.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(45)] + [(7, 7), (1, 0)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_pairs_of_a_large_bucket_are_verified_whatever_their_registers(spark):
    rules = near.NearRules(block=4)
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rng = np.random.default_rng(5)
    band = [7] * rules.rows

    def member(doc, body):  # one band in common, the other registers by chance
        rest = rng.integers(0, 2**31 - 1, rules.registers - rules.rows)
        return doc, doc, 1, [*band, *map(int, rest)], near.packed(body, rules.words)

    rows = [member(1, text), member(2, text), member(3, other)]
    members = spark.createDataFrame(rows, "doc long, root long, team long, sig array<int>, feature binary")
    links = {tuple(sorted(r)) for r in near._block_links(members, rules).collect()}
    assert links == {(1, 2)}


def test_cells_of_one_large_group_are_dealt_over_tasks(spark):
    rules = near.NearRules(block=4)
    feature = near.packed(" ".join(f"w{i}" for i in range(60)), rules.words)
    rows = [(doc, doc, 1, [7] * rules.registers, feature) for doc in range(1, 41)]
    members = spark.createDataFrame(rows, "doc long, root long, team long, sig array<int>, feature binary")
    # As in a group too large to be broadcast: a join deals its rows by team.
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        links = near._block_links(members, rules).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert len({r.task for r in links}) > 4
    found = {r.node for r in components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).where("root = 1").collect()}
    assert found == set(range(2, 41))
