"""Resampling and ranked search against plain versions, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tools.check_queries import compare, connect
from weirworks.llm import bestposition, resample
from weirworks.llm.packing import pack, unpack
from weirworks.llm.queries import load

QUERIES, ORACLES = load()
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_resample(docs, target, rules=resample.ResampleRules()):
    """Rows (doc_id, n_features, weight, score, rank) in the order of ``docs``."""

    def buckets(text):
        words = re.findall(resample.WORD, (text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % rules.buckets for r in runs]

    source, aim = Counter(), Counter()
    for _, text in docs:
        source.update(buckets(text)[1])
    for text in target:
        aim.update(buckets(text)[1])
    s_all, t_all, size = sum(source.values()), sum(aim.values()), rules.buckets
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + size) / ((source[b] + 1) * (t_all + size)))) for b in range(size)]
    rows = []
    for i, (doc, text) in enumerate(docs):
        n, found = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= rules.min_words, i])
    drawn = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(drawn[: rules.percent * len(drawn) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in rows]


def test_word_runs_hash_as_their_bytes():
    text = "Añb  c1-d " + "x" * 300 + " é\x85f g_h A" * 40
    hasher = resample.RunHasher(resample.ResampleRules())
    sizes, pieces = hasher.runs([text, None, "", "one", "one two"])
    got = sorted((int(o), int(b)) for owner, buckets in pieces for o, b in zip(owner, buckets, strict=True))
    wanted = []
    for k, t in enumerate([text, "", "", "one", "one two"]):
        words = re.findall(resample.WORD, t.translate(LOWER))
        assert sizes[k] == len(words)
        wanted += [(k, zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert got == sorted(wanted)


def test_resample_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = QUERIES["op12_target_resample"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_resample(docs, target))
    assert got.where("rank is not null").count() > 5


def test_resample_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 50)
    long = " ".join(f"w{i % 97}" for i in range(5000))
    docs = [(i, f"alpha beta {'gamma ' * (i % 7)} delta" * 6) for i in range(300)] + [(None, long), (7, long), (8, None), (9, ""), (9, "-- \n"), (301, "ÀÉ ß \x85 ſ" * 30)]
    docs += [(400, docs[3][1])] * 40
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, rank int, score string").repartition(7)
    for target in (["alpha gamma gamma", None, ""], []):
        aim = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
        got = [tuple(r) for r in resample.resample(frame, aim).collect()]
        wanted = brute_resample(docs, target)
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(got, key=key) == sorted(wanted, key=key)
    assert resample.resample(frame.limit(0), aim).count() == 0
    assert {r.rank for r in resample.resample(frame.where("doc_id = 9"), aim).collect()} == {None}


def test_cutoff_is_exact_with_hot_ties(spark):
    rng = np.random.default_rng(1)
    score = np.where(rng.random(3000) < 0.4, 5, rng.integers(-50, 50, 3000))
    rows = [(int(s), int(i)) for s, i in zip(score, rng.permutation(3000) % 2000, strict=True)]
    keys = spark.createDataFrame(rows, "score long, id long").repartition(9)
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 700, 1500, 2999, 3000):
        found = resample.cutoff(keys, k)
        assert (found.score, found.id) == order[k - 1]
    assert resample.cutoff(keys, 0) is None and resample.cutoff(keys, 3001) is None


def brute_search(docs, items, k=10):
    cut = lambda text: re.findall(bestposition.TERM, (text or "").translate(LOWER))
    texts = [(d, Counter(cut(text))) for d, text in docs]
    texts = [(d, c, sum(c.values())) for d, c in texts if c]
    n_docs, n_terms, df = len(texts), sum(n for *_, n in texts), Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c, n in texts:
            m = 25 + (75 * n * n_docs) // n_terms
            got = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if got > 0:
                rows.append((-got, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1)]
    return out


def test_search_matches_sql(spark, sf_dir):
    ok, message, _ = compare(spark, connect(sf_dir), QUERIES["op13_best_position_search"], ORACLES["op13_best_position_search"], sf_dir)
    assert ok, message


@pytest.mark.parametrize("rules", [bestposition.SearchRules(block_postings=60, block_docs=20, block_terms=4, step=2), bestposition.SearchRules()])
def test_search_odd_rows(spark, rules):
    rng = np.random.default_rng(4)
    docs = [(int(i), " ".join(f"t{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 40)) if x < 500)) for i in range(250)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "t1 " * 3000), (2003, "Été-ÉTÉ t3\x85t4")]
    items = [(1, "t1 T1 t3, t9"), (2, None), (3, ""), (4, "nowhere"), (5, "t2 t40 t41 t1"), (6, "été ÉtÉ t3\x85t4"), (7, "t1"), (8, docs[5][1])]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, codes string").repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, salt int").repartition(3)
    got = bestposition.search(frame, asked, rules)
    key = lambda r: (r[0], r[1])
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_search(docs, items), key=key)
    assert bestposition.search(frame.limit(0), asked, rules).count() == 0
    assert bestposition.search(frame, asked.limit(0), rules).count() == 0


def test_best_positions_stop_early():
    """On lists that agree, the search ends after a small share of the entries."""
    n = 5000
    lists = [bestposition.ImpactList(np.arange(n), np.arange(n, 0, -1) ** 2) for _ in range(3)]
    top, scores, read = bestposition.best_positions(lists, n, 10, 16, np.arange(n))
    assert top.tolist() == list(range(10)) and scores[0] == 3 * n * n and read < 200
    # Ties at the k-th place are met before the search stops.
    flat = [bestposition.ImpactList(np.arange(n)[::-1], np.full(n, 7))]
    assert bestposition.best_positions(flat, n, 10, 16, np.arange(n))[0].tolist() == list(range(10))


def test_packing_round_trip():
    arrays = [np.array([], dtype=np.int64), np.arange(-3, 300), np.array([2**62, -(2**63)]), np.zeros(9, dtype=np.int64)]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))
