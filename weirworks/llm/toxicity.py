"""Toxicity by a chain of linear classifiers over the words of a text.

Categories are predicted one after the other: the model of a later category also sees the log-odds of all earlier ones. In
training these come from models that did not see the row (out-of-fold), so a later model learns how far to trust them.
Each model is a logistic regression on the presence of those words, and word beginnings, that go with its label.

Training uses the labelled rows with the ``sample_rows`` smallest hashes of their id, a bounded sample whose size does not
depend on the corpus (its rows are bounded, the length of a text is not); prediction reads every whole text.

Definitions: words are lower-cased runs of letters, digits and underscores; how often a word occurs does not matter. A null
text is empty and gets the models' base rates. Rows that lack a label of any category are not trained on. A
category with one label value only is always predicted as that value. Without any labelled row nothing is rejected. Training
takes one row for each id: of labels that repeat an id the largest, compared in the order of the chain, and of documents that
do the text with the largest md5. Extra columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import pick, quoted, ship, text_of

_WORD = re.compile(r"\w+")
#: Words whose weights a worker remembers.
MEMO = 400_000
#: Longer words also count by so many first characters, so that rare forms share what is learnt.
STEMS = (4,)


@dataclass(frozen=True)
class ToxicRules:
    sample_rows: int = 8_000
    folds: int = 3
    #: Word hashes are cut to this many bits.
    bits: int = 20
    #: Words in fewer training rows than this are not used.
    min_rows: int = 5
    #: Words enter a model if they go with its label this many standard deviations more, or less, than by chance.
    min_z: float = 4.0
    steps: int = 400
    #: Strength of the penalty on squared weights, for each row.
    penalty: float = 1e-5
    threshold: float = 0.3


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def codes_of(word: str, bits: int) -> list[int]:
    """Codes of a word and of the stems it starts with."""
    parts = [word, *[f"{word[:stem]}*" for stem in STEMS if len(word) > stem]]
    return [xxhash.xxh3_64_intdigest(part) & ((1 << bits) - 1) for part in parts]


@dataclass
class Link:
    """The model of one category: weights of word codes, of earlier categories, and a constant."""

    name: str
    weights: dict[int, float]
    earlier: np.ndarray
    constant: float


class Rows:
    """Training rows: sorted columns of each row in one flat array, with dense extra columns beside it."""

    def __init__(self, columns: list[np.ndarray], width: int):
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int64)
        self.flat = np.concatenate(columns) if columns else np.zeros(0, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(columns)), np.diff(self.starts))
        self.width = width

    def take(self, keep: np.ndarray) -> Rows:
        return Rows([self.flat[self.starts[i] : self.starts[i + 1]] for i in np.flatnonzero(keep)], self.width)

    def only(self, used: np.ndarray) -> Rows:
        """The same rows with the marked columns only, renumbered."""
        kept, place, narrow = used[self.flat], np.cumsum(used) - 1, Rows([], int(used.sum()))
        narrow.flat, narrow.owner, narrow.starts = place[self.flat[kept]], self.owner[kept], self.starts
        return narrow

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], minlength=len(self.starts) - 1)

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, residual[self.owner], minlength=self.width)


def fit(rows: Rows, dense: np.ndarray, label: np.ndarray, rules: ToxicRules) -> tuple[np.ndarray, np.ndarray, float]:
    """(word weights, dense weights, constant) of a logistic regression on the words that go with the label.

    Steps have a size of their own for each column, so that rare words learn as fast as frequent ones.
    """
    n, positive = len(label), float(label.sum())
    count, hits = rows.back(np.ones(n)), rows.back(label)
    expected = count * positive / max(n, 1)
    spread = np.sqrt(np.maximum(expected * (1 - positive / max(n, 1)) * (1 - count / max(n, 1)), 1e-9))
    used = np.abs(hits - expected) >= rules.min_z * np.maximum(spread, 0.5)
    narrow = rows.only(used)
    weights, extra = np.zeros(int(used.sum())), np.zeros(dense.shape[1])
    constant = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    scale, scale_extra, scale_constant = np.full(len(weights), 1e-12), np.full(len(extra), 1e-12), 1e-12
    for _ in range(rules.steps):
        z = narrow.times(weights) + dense @ extra + constant
        residual = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        slope = narrow.back(residual) / n + rules.penalty * weights
        slope_extra = dense.T @ residual / n + rules.penalty * extra
        slope_constant = float(residual.mean())
        scale, scale_extra, scale_constant = scale + slope**2, scale_extra + slope_extra**2, scale_constant + slope_constant**2
        weights = weights - slope / np.sqrt(scale)
        extra = extra - 0.1 * slope_extra / np.sqrt(scale_extra)
        constant -= 0.5 * slope_constant / np.sqrt(scale_constant)
    whole = np.zeros(rows.width)
    whole[used] = weights
    return whole, extra, constant


def train(sample: pd.DataFrame, categories: list[str], rules: ToxicRules) -> list[Link]:
    """The chain from rows with ``text`` and a 0/1 column for each category."""
    codes = [np.array(sorted({c for w in words_of(text or "") for c in codes_of(w, rules.bits)}), dtype=np.int64) for text in sample["text"]]
    if not codes:
        return [Link(name, {}, np.zeros(i), -30.0) for i, name in enumerate(categories)]
    count = np.bincount(np.concatenate(codes), minlength=1 << rules.bits)
    used = np.flatnonzero(count >= rules.min_rows)
    rows = Rows([np.searchsorted(used, c[count[c] >= rules.min_rows]) for c in codes], len(used))
    fold = sample["fold"].to_numpy() % rules.folds
    dense, chain = np.zeros((len(sample), 0)), []
    for name in categories:
        label = sample[name].to_numpy(dtype=np.float64)
        weights, extra, constant = fit(rows, dense, label, rules)
        kept = np.flatnonzero(weights)
        chain.append(Link(name, dict(zip(used[kept].tolist(), weights[kept].tolist(), strict=True)), extra, constant))
        if len(chain) < len(categories):
            held_out = np.zeros(len(sample))
            for part in range(rules.folds):
                seen, asked = fold != part, fold == part
                w, e, c = fit(rows.take(seen), dense[seen], label[seen], rules) if seen.any() else (weights, extra, constant)
                held_out[asked] = np.clip(rows.take(asked).times(w) + dense[asked] @ e + c, -10, 10)
            dense = np.column_stack([dense, held_out])
    return chain


class Known(dict):
    """(code, weight in every model of the chain) of a word and its stems, where any weight is not zero."""

    def __init__(self, links: list[Link], bits: int):
        super().__init__()
        self.links, self.bits = links, bits

    def __missing__(self, word: str) -> tuple:
        if len(self) >= MEMO:
            self.clear()
        entries = [(code, *[link.weights.get(code, 0.0) for link in self.links]) for code in codes_of(word, self.bits)]
        found = self[word] = tuple(entry for entry in entries if any(entry[1:]))
        return found


class Chain:
    """Prediction with a trained chain."""

    def __init__(self, links: list[Link], bits: int):
        self.links, self.known = links, Known(links, bits)

    def predict(self, text: str) -> list[float]:
        """Probability of each category, in the order of the chain."""
        known = self.known
        # A code counts once, as in training; in sorted order, so that sums do not depend on the set's.
        active = sorted({entry for word in words_of(text) if (found := known[word]) for entry in found})
        odds: list[float] = []
        for k, link in enumerate(self.links):
            z = link.constant + sum(found[k + 1] for found in active)
            odds.append(z + float(np.dot(link.earlier, np.clip(odds, -10, 10))) if k else z)
        return [float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) for z in odds]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], rules: ToxicRules, id_col: str, text_col: str) -> list[Link]:
    """The chain, trained in one task on the bounded sample.

    The ids of the sample are chosen from the labels alone, then only their texts are fetched.
    """
    names = list(categories)
    complete = labels.where(F.col(quoted(id_col)).isNotNull()).select(
        F.col(quoted(id_col)).alias("label_id"), *[c.cast("int").alias(f"c{i}") for i, c in enumerate(categories.values())]
    ).dropna()
    values = [f"c{i}" for i in range(len(categories))]
    once = complete.groupBy("label_id").agg(F.max(F.struct(*values)).alias("most")).select("label_id", "most.*")
    once = once.withColumn("fold", F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(1 << 20)))
    chosen = once.orderBy(F.xxhash64("label_id"), "label_id").limit(rules.sample_rows)
    texts = pick(docs, doc_id=id_col, text=text_col)
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"])
    # One row for each id before all go to one task.
    found = found.groupBy("doc_id", "fold", *values).agg(F.max_by("text", F.md5("text")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        parts = list(batches)
        if parts:
            frame = pd.concat(parts).sort_values(["fold", "doc_id", "text"]).reset_index(drop=True)
            chain = train(frame.rename(columns={f"c{i}": name for i, name in enumerate(names)}), names, rules)
            yield pd.DataFrame({"chain": [pickle.dumps(chain)]})

    trained = found.repartition(1).mapInPandas(run, "chain binary").collect()
    return pickle.loads(bytes(trained[0].chain)) if trained else train(pd.DataFrame({"text": []}), names, rules)


def score(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], rules: ToxicRules = ToxicRules(),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, p_<category> ..., toxic): probabilities of every document and the decision on the last category.

    ``categories``: name and 0/1 expression over ``labels``, in the order of the chain.
    """
    spark = docs.sparkSession
    ship(spark)
    names = list(categories)
    links = fit_chain(docs, labels, categories, rules, id_col, text_col)
    shared = spark.sparkContext.broadcast(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        chain = Chain(shared.value, rules.bits)
        for batch in batches:
            rows = np.array([chain.predict(text or "") for text in batch.column(1).to_pylist()]).reshape(-1, len(names))
            columns = [pa.array(rows[:, k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *[f"p_{n}" for n in names]])

    source = docs.select(docs[quoted(id_col)].alias("doc_id"), text_of(docs[quoted(text_col)]).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"`p_{n}` double" for n in names]]))
    return scored.withColumn("toxic", F.col(quoted(f"p_{names[-1]}")) >= rules.threshold)


def default_categories(labels: DataFrame) -> dict[str, Column]:
    """The chain for the labels table: low quality first, then toxicity."""
    return {"low_quality": 1 - labels["quality"], "toxic": labels["toxic"]}


def toxic_documents(docs: DataFrame, labels: DataFrame, rules: ToxicRules = ToxicRules()) -> DataFrame:
    """The rows of ``score`` that are rejected."""
    return score(docs, labels, default_categories(labels), rules).where("toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, rules: ToxicRules = ToxicRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, without the rejected documents. Rows without an id stay."""
    rejected = score(docs, labels, default_categories(labels), rules, id_col, text_col).where("toxic").select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(rejected, docs[quoted(id_col)] == rejected["_rejected"], "left_anti")
