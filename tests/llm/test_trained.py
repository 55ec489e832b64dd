"""Language identification and toxicity: gradients, out-of-fold chains, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirworks.llm import langid, toxicity

TABLES = "/root/testdata/sf0.01"


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    network = langid.Network(["a", "b", "c"], langid.LanguageRules(hidden=3))
    network.params["v"] = rng.normal(size=(3, 6)).astype(np.float32)
    codes, label = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])
    for params, slopes in network.loss_and_gradients(codes, label)[1]:
        for name, slope in slopes.items():
            at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
            kept, step, losses = params[name][at], 1e-2, []
            for value in (kept + step, kept - step):
                params[name][at] = value
                losses.append(network.loss_and_gradients(codes, label)[0])
            params[name][at] = kept
            assert slope[at] == pytest.approx((losses[0] - losses[1]) / (2 * step), rel=2e-2)


def test_windows_and_batches_do_not_change_a_document():
    network = langid.Network(["a", "b"], langid.LanguageRules(window=16, together=3))
    network.params["v"] = np.random.default_rng(1).normal(size=(2, 16)).astype(np.float32)
    texts = [b"one", b"x" * 16, b"words " * 40, b"", b"y" * 33]
    together = network.predict(texts)
    for text, row in zip(texts, together, strict=True):
        assert network.predict([text])[0] == pytest.approx(row, abs=1e-5)
    assert together[3].tolist() == [0, 0] and np.delete(together, 3, 0).sum(1) == pytest.approx(1, abs=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    odd = [(900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, "123 ... 456", None, "s", 0), (None, docs.where("lang = 'en'").first().text, None, "s", 0)]
    long = docs.where("lang = 'de'").first().text * 60
    table = docs.unionAll(spark.createDataFrame([*odd, (900_004, long, "de", "s", 0)], docs.schema)).withColumn("held_out", F.lit("x")).withColumn("letters", F.lit(1))
    network = langid.learn(table, langid.LanguageRules(steps=300))
    got = langid.identify(table, network).collect()
    assert len(got) == docs.count() + 5
    rows = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items() if i is not None)
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (900_001, 900_002, 900_003)) and rows[900_004].lang_pred == "de"
    right = [rows[r.doc_id].lang_pred == r.lang for r in docs.collect() if rows[r.doc_id].held_out]
    assert len(right) > 150 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.learn(table.where("lang IS NULL")) is None
    assert {r.lang_pred for r in langid.identify(table.limit(3), None).collect()} == {"und"}
    assert langid.identify(table.limit(0), network).count() == 0


def test_chain_feeds_out_of_fold_odds_to_later_models():
    rng, rows = np.random.default_rng(2), []
    for i in range(900):
        rude, worse = rng.random() < 0.4, rng.random() < 0.5
        words = [f"w{rng.integers(60)}" for _ in range(12)] + ["rude"] * int(rude)
        rows.append((" ".join(words), int(rude), int(rude and worse), i))
    sample = pd.DataFrame(rows, columns=["text", "rude", "severe", "fold"])
    rules = toxicity.ToxicRules()
    chain = toxicity.train(sample, ["rude", "severe"], rules)
    assert len(chain[0].earlier) == 0 and len(chain[1].earlier) == 1
    model = toxicity.Chain(chain, rules.bits)
    p = np.array([model.predict(text) for text in sample["text"]])
    assert ((p[:, 0] > 0.5) == (sample["rude"] == 1)).mean() > 0.99
    assert p[sample["rude"] == 0, 1].max() < 0.3 < p[sample["rude"] == 1, 1].mean()
    # A first model that knows nothing does not spoil the second one.
    blind = toxicity.Chain(toxicity.train(sample.assign(rude=rng.integers(0, 2, len(sample))), ["rude", "severe"], rules), rules.bits)
    q = np.array([blind.predict(text)[1] for text in sample["text"]])
    assert q[sample["rude"] == 0].max() < 0.3 < q[sample["rude"] == 1].mean()


def test_toxic_documents_of_unseen_labels(spark):
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    english = docs.where("lang = 'en'")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    extra = [(1, None, None), (None, 1, 1), (5, 1, None)]
    train = train.unionAll(spark.createDataFrame(extra, labels.schema)).withColumn("text", F.lit("no text")).withColumn("fold", F.lit(0))
    rows = [(900_001, None), (900_002, ""), (None, "you idiot and scum, worthless moron " * 900)]
    table = english.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("fold", F.lit("f")).withColumn("toxic", F.lit("t"))
    found = {r.doc_id for r in toxicity.toxic_documents(table, train).collect()}
    truth = {r.doc_id: r.toxic for r in test.join(english.select("doc_id"), "doc_id").collect()}
    bad = {i for i, toxic in truth.items() if toxic}
    assert bad <= found and not {i for i, toxic in truth.items() if not toxic} & found
    assert None in found and not {900_001, 900_002} & found
    kept = toxicity.drop_toxic(table, train)
    assert kept.columns == table.columns and kept.where("doc_id IS NULL").count() == 1
    assert {r.doc_id for r in kept.collect()} - {None} == {r.doc_id for r in table.collect()} - found
    none = labels.limit(0)
    assert toxicity.score(table, none, toxicity.default_categories(none)).where("toxic").count() == 0
    assert toxicity.toxic_documents(table.limit(0), train).count() == 0


def test_repeated_ids_do_not_change_the_toxicity_sample(spark):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    texts = [(i, " ".join(["bad", "awful"] if i % 2 == 0 else ["good", "kind"]) + f" word{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rules = toxicity.ToxicRules(sample_rows=30, min_z=1.0)
    first = labels.orderBy(F.xxhash64("doc_id")).first().doc_id
    often = [r for r in texts if r[0] == first] * 20
    more_docs = docs.unionAll(spark.createDataFrame(often, docs.schema))
    more_labels = labels.unionAll(spark.createDataFrame([r for r in labels.collect() if r.doc_id == first] * 20, labels.schema))

    def fitted(d, given):
        chain = toxicity.fit_chain(d, given, toxicity.default_categories(given), rules, "doc_id", "text")
        return [(link.name, link.weights, link.earlier.tolist(), link.constant) for link in chain]

    assert fitted(more_docs, more_labels) == fitted(docs, labels)


def test_repeated_ids_do_not_change_the_language_sample(spark):
    rows = [(i, f"{word} {i} {word}", lang) for i in range(24) for word, lang in [("the house", "en") if i % 2 else ("das haus", "de")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    free = docs.where(~langid.held_out(F.col("doc_id")))
    first = free.orderBy(F.xxhash64("doc_id")).first()
    more = docs.unionAll(spark.createDataFrame([first] * 20, docs.schema))
    rules = langid.LanguageRules(per_language=4, sample_docs=8, steps=3)
    one, two = langid.learn(docs, rules), langid.learn(more, rules)
    assert (one.params["v"] == two.params["v"]).all() and (one.forward.params["x"] == two.forward.params["x"]).all()
