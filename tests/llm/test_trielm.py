"""Elias-Fano sequences and tries against plain arrays; the model against a dictionary version."""

import zlib
from collections import Counter

import numpy as np
import pytest

from weirworks.llm import trielm
from weirworks.llm.eliasfano import EliasFano, TrigramTrie
from weirworks.llm.queries import load


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    n, top = int(rng.integers(0, 3000)), int(10 ** rng.uniform(0, 12))
    values = np.sort(rng.integers(0, top, n))
    if seed == 5:
        values = np.sort(np.concatenate([np.zeros(200, dtype=np.int64), values, np.full(300, top * 5), [2**52]]))
    coded = EliasFano.of(values)
    assert np.array_equal(coded.get(np.arange(len(values))), values)
    asked = np.concatenate([values, values + 1, values - 1, rng.integers(0, top + 10, 50), [-1, 2**53]]).astype(np.int64)
    place = np.searchsorted(values, asked)
    wanted = np.where(np.isin(asked, values), place, -1)
    assert np.array_equal(coded.find(asked), wanted)
    if len(values) > 1000:
        assert coded.low.nbytes * 8 / len(values) <= max(0, np.log2((values[-1] + 1) / len(values))) + 1


def test_trie_finds_what_it_holds(tmp_path):
    rng = np.random.default_rng(9)
    runs = np.unique(rng.zipf(1.5, (4000, 3)) % 70, axis=0)
    pairs, words = np.unique(runs[:, :2], axis=0), np.unique(runs[:, 0])
    pair_key, run_key = pairs @ [100, 1], runs[:, :2] @ [100, 1]
    values = {"word_code": np.arange(len(words)), "pair_code": np.arange(len(pairs)), "pair_norm": -np.arange(len(pairs)), "run_code": np.arange(len(runs))}
    trie = TrigramTrie.of(words, (np.searchsorted(words, pairs[:, 0]), pairs[:, 1]), (np.searchsorted(pair_key, run_key), runs[:, 2]), {k: v.astype("<i2") for k, v in values.items()})
    path = tmp_path / "trie"
    path.write_bytes(trie.to_bytes())
    asked = np.concatenate([runs, rng.integers(0, 75, (3000, 3))])
    held = {tuple(r): i for i, r in enumerate(runs.tolist())} | {tuple(r): i for i, r in enumerate(pairs.tolist())} | {(w,): i for i, w in enumerate(words.tolist())}
    wanted = [[held.get(tuple(q[:k]), -1) for k in (1, 2, 3)] for q in asked.tolist()]
    for opened in (trie, TrigramTrie.mapped(trie.to_bytes()), TrigramTrie.open(str(path))):
        assert np.array_equal(np.array(opened.find(*asked.T)).T, wanted)
        assert np.array_equal(opened.values["run_code"], np.arange(len(runs)))


def brute(docs, rules=trielm.ModelRules()):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % rules.folds == rules.fold
    texts = [(d, trielm.words_of(t) + ["end"], held(d)) for d, t in docs]
    one, two, three, pad = Counter(), Counter(), Counter(), ["start", "start"]
    for _, words, out in texts:
        if not out:
            one.update(words)
            for a, b, c in zip(pad + words, pad[1:] + words, words, strict=False):
                two[b, c] += 1
                three[a, b, c] += 1
    n, v = sum(one.values()), len(one)
    one["start"] = sum(not out for *_, out in texts)
    step = lambda x: int(trielm.steps(x))
    rows = []
    for d, words, out in texts:
        units, base = -step(one["start"] + rules.run_prior), 0.0
        for a, b, c in zip(pad + words, pad[1:] + words, words, strict=False):
            p1 = (one[c] + 1) / (n + v + 1)
            base += np.log10(p1)
            p2 = (two[b, c] + rules.pair_prior * p1) / (one[b] + rules.pair_prior)
            if three[a, b, c]:
                units += step(three[a, b, c] + rules.run_prior * p2)
            elif two[b, c]:
                units += step(p2) + step(rules.run_prior)
            else:
                units += step(p1) + step(rules.pair_prior) - step(one[b] + rules.pair_prior) + step(rules.run_prior)
            units -= step(two[b, c] + rules.run_prior) if c != "end" else 0
        rows.append((d, out, len(words), sum(w in one and one[w] > 0 for w in words), n, round(base, 6), units / trielm.STEP))
    return rows


def plain(frame):
    return [(*r[:5], round(r[5], 6), r[6]) for r in map(tuple, frame.collect())]


KEY = {"key": lambda r: tuple((x is None, x or 0) for x in r)}


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = load()[0]["op11_trie_scores"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = plain(got)
    assert sorted(rows) == sorted(brute(docs))
    out = [r for r in rows if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)  # better than single words on texts not learnt


SMALL = trielm.ModelRules(block_tokens=40, shard_positions=60, dictionary_words=30)


@pytest.mark.parametrize("rules", [trielm.ModelRules(), SMALL])
def test_odd_rows_and_hot_runs(spark, rules):
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(f"W{int(x)}" for x in rng.zipf(1.6, rng.integers(0, 30)))) for i in range(120)]
    docs += [(i, "a a a a a a b") for i in range(200, 300)] + [(400, "a " * 300 + "é\x85x\tÉ"), (None, "x a a"), (None, None), (7, "a a a"), (401, ""), (402, " \n\x0b "), (403, "a b")]
    frame = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, block int, row string").repartition(4)
    assert sorted(plain(trielm.score_texts(frame, rules)), **KEY) == sorted(brute(docs, rules), **KEY)
    assert trielm.score_texts(frame.limit(0), rules).count() == 0
    held = [d for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 2][:4]
    only = spark.createDataFrame(held, "doc_id long, text string")
    assert sorted(plain(trielm.score_texts(only, rules))) == sorted(brute(held, rules))


def test_hot_runs_are_split(spark, monkeypatch):
    docs = [(i, "a a a a b") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen = []
    real = trielm.often_runs
    monkeypatch.setattr(trielm, "often_runs", lambda *a: seen.append(real(*a)) or seen[-1])
    rows = plain(trielm.score_texts(frame, SMALL))
    assert {len(k) for k in seen[0]} == {2, 3} and len(rows) == 300
    assert sorted(rows) == sorted(brute(docs, SMALL))
