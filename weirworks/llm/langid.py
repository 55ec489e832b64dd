"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers read a window of bytes, one forwards and one backwards; their states at a byte give the probability of
each language at that byte. A document is cut into windows, all of its bytes are labelled, and its probabilities are the
means over them. The network is written in numpy and trained by backpropagation through time.

Training uses windows of a bounded sample of labelled documents: ``per_language`` of each language with the smallest hashes
of their id, ``sample_docs`` in all, one text for each id and language: of several that with the largest md5. The rows of the
sample are bounded, the length of a text is not. Prediction reads text only.

Definitions: documents whose crc32 of the id as text leaves 2 on division by 4 are held out of training; a null id counts as
the empty text. Null languages are not learned. A text that is null or has no letter is ``und`` with score 0; so is
every text if nothing can be learned. Ties go to the language first in alphabetical order. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship, text_of

UNKNOWN = "und"
PAD = 32


@dataclass(frozen=True)
class LanguageRules:
    per_language: int = 400
    sample_docs: int = 4_000
    hidden: int = 8
    #: Bytes of a training window, windows of a step, steps.
    train_window: int = 48
    batch: int = 192
    steps: int = 500
    rate: float = 0.02
    #: Bytes of a window in prediction, windows computed together.
    window: int = 128
    together: int = 2_048
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Direction:
    """One gated recurrent layer; arrays are features x windows. Rows of gates: update, reset, candidate."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.params = {
            "x": rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32),
            "u": rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32),
            "b": np.zeros((hidden, 1), dtype=np.float32),
        }

    def states(self, codes: np.ndarray) -> np.ndarray:
        """steps x hidden x windows from steps x windows of bytes."""
        h, steps, count = self.hidden, *codes.shape
        # Half of the gates' input: a logistic is half of a tanh of half its input, plus a half.
        halves = np.repeat(np.array([0.5, 0.5, 1.0], dtype=np.float32), h)[:, None]
        x, u, b = self.params["x"] * halves, self.params["u"] * halves, self.params["b"]
        out = np.empty((steps, h, count), dtype=np.float32)
        state, gates, seen = np.zeros((h, count), dtype=np.float32), np.empty((3 * h, count), dtype=np.float32), np.empty((3 * h, count), dtype=np.float32)
        for t in range(steps):
            np.matmul(u, state, out=gates)
            np.take(x, codes[t], axis=1, out=seen, mode="clip")
            both = gates[: 2 * h]
            both += seen[: 2 * h]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            candidate = gates[2 * h :]
            candidate += b
            candidate *= both[h:]
            candidate += seen[2 * h :]
            np.tanh(candidate, out=candidate)
            state = out[t]
            np.subtract(out[t - 1] if t else 0, candidate, out=state)
            state *= both[:h]
            state += candidate
        return out

    def gradients(self, codes: np.ndarray, out: np.ndarray, into: np.ndarray) -> dict[str, np.ndarray]:
        """Of a loss whose slope at the states is ``into``, through all steps back to the first."""
        h, steps, count = self.hidden, *codes.shape
        x, u, b = (self.params[k].astype(np.float64) for k in "xub")
        slope_u, slope_b = np.zeros_like(u), np.zeros_like(b)
        seen_slopes = np.empty((steps, 3 * h, count))
        back = np.zeros((h, count))
        for t in range(steps - 1, -1, -1):
            before = out[t - 1].astype(np.float64) if t else np.zeros((h, count))
            gates, seen = u @ before, x[:, codes[t]]
            update = 1 / (1 + np.exp(-(gates[:h] + seen[:h])))
            reset = 1 / (1 + np.exp(-(gates[h : 2 * h] + seen[h : 2 * h])))
            inner = gates[2 * h :] + b
            candidate = np.tanh(seen[2 * h :] + reset * inner)
            slope = into[t] + back
            d_candidate = slope * (1 - update) * (1 - candidate**2)
            d_update = slope * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * inner * reset * (1 - reset)
            seen_slopes[t] = np.concatenate([d_update, d_reset, d_candidate])
            gate_slopes = np.concatenate([d_update, d_reset, d_candidate * reset])
            slope_u += gate_slopes @ before.T
            slope_b += gate_slopes[2 * h :].sum(1, keepdims=True)
            back = slope * update + u.T @ gate_slopes
        flat = codes.ravel()
        slope_x = np.stack([np.bincount(flat, seen_slopes[:, row].ravel(), minlength=256) for row in range(3 * h)])
        return {"x": slope_x, "u": slope_u, "b": slope_b}


class Network:
    def __init__(self, languages: list[str], rules: LanguageRules):
        rng = np.random.default_rng(rules.seed)
        self.languages, self.rules = languages, rules
        self.forward, self.backward = Direction(rules.hidden, rng), Direction(rules.hidden, rng)
        self.params = {"v": np.zeros((len(languages), 2 * rules.hidden), dtype=np.float32), "c": np.zeros((len(languages), 1), dtype=np.float32)}

    def states(self, codes: np.ndarray) -> np.ndarray:
        """steps x (2 hidden) x windows."""
        return np.concatenate([self.forward.states(codes), self.backward.states(codes[::-1])[::-1]], axis=1)

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """steps x languages x windows."""
        scores = self.params["v"] @ states + self.params["c"]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def loss_and_gradients(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, list[tuple[dict, dict]]]:
        """Mean cross entropy over all positions, and (parameters, slopes) of each part."""
        states, (steps, count) = self.states(codes), codes.shape
        probability = self.probabilities(states).astype(np.float64)
        at = np.arange(count)
        loss = -float(np.log(np.maximum(probability[:, label, at], 1e-12)).mean())
        slope = probability
        slope[:, label, at] -= 1
        slope /= steps * count
        into = np.einsum("kh,tkn->thn", self.params["v"].astype(np.float64), slope)
        own = {"v": np.einsum("tkn,thn->kh", slope, states, optimize=True), "c": slope.sum((0, 2))[:, None]}
        h = self.rules.hidden
        ahead = self.forward.gradients(codes, states[:, :h], into[:, :h])
        behind = self.backward.gradients(codes[::-1], states[::-1, h:], into[::-1, h:])
        return loss, [(self.params, own), (self.forward.params, ahead), (self.backward.params, behind)]

    def train(self, texts: list[bytes], labels: np.ndarray) -> float:
        """Steps of Adam on random windows, each language as often as any other; returns the last loss."""
        rules, rng, loss = self.rules, np.random.default_rng(self.rules.seed + 1), 0.0
        by_language = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first, second = {}, {}
        for step in range(1, rules.steps + 1):
            label = rng.integers(0, len(self.languages), rules.batch)
            codes = np.full((rules.train_window, rules.batch), PAD, dtype=np.int64)
            for n, k in enumerate(label):
                text = texts[by_language[k][rng.integers(len(by_language[k]))]]
                start = int(rng.integers(0, max(1, len(text) - rules.train_window + 1)))
                window = np.frombuffer(text[start : start + rules.train_window], dtype=np.uint8)
                codes[: len(window), n] = window
            loss, parts = self.loss_and_gradients(codes, label)
            rate = rules.rate * min(1.0, 2 * (1 - (step - 1) / rules.steps))
            for place, (params, slopes) in enumerate(parts):
                for name, slope in slopes.items():
                    key = (place, name)
                    first[key] = 0.9 * first.get(key, 0) + 0.1 * slope
                    second[key] = 0.999 * second.get(key, 0) + 0.001 * slope**2
                    change = first[key] / (1 - 0.9**step) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)
                    params[name] -= (rate * change).astype(np.float32)
        return loss

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages: mean probabilities over all bytes; zeros for empty texts."""
        rules, totals = self.rules, np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        windows = -(-sizes // rules.window)
        owner = np.repeat(np.arange(len(texts)), windows)
        padded = b"".join(t.ljust(int(n) * rules.window, bytes([PAD])) for t, n in zip(texts, windows, strict=True))
        codes = np.frombuffer(padded, dtype=np.uint8).reshape(-1, rules.window)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        real = np.minimum(sizes[owner] - place * rules.window, rules.window)
        for begin in range(0, len(owner), rules.together):
            some = slice(begin, begin + rules.together)
            steps = np.ascontiguousarray(codes[some].T)
            probability = self.probabilities(self.states(steps))
            if (short := real[some] < rules.window).any():
                probability[:, :, short] *= (np.arange(rules.window)[:, None] < real[some][short])[:, None, :]
            sums = probability.sum(0)
            for k in range(len(self.languages)):
                totals[:, k] += np.bincount(owner[some], sums[k], minlength=len(texts))
        return totals / np.maximum(sizes, 1)[:, None]


def learn(docs: DataFrame, rules: LanguageRules = LanguageRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained in one task on the bounded sample; None if there is nothing to learn from."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = rows.select("doc_id", "lang").distinct().withColumn("place", place).where(F.col("place") <= rules.per_language)
    chosen = ranked.orderBy("place", "lang").limit(rules.sample_docs).select(F.col("doc_id").alias("chosen"), F.col("lang").alias("chosen_lang"))
    matched = rows.join(F.broadcast(chosen), rows["doc_id"].eqNullSafe(F.col("chosen")) & (rows["lang"] == F.col("chosen_lang")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        parts = list(batches)
        if parts:
            sample = pd.concat(parts).sort_values(["lang", "doc_id", "text"])
            languages = sorted(sample["lang"].unique())
            network = Network(languages, rules)
            labels = sample["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy()
            network.train([text.encode("utf-8", "replace") for text in sample["text"]], labels)
            yield pd.DataFrame({"network": [pickle.dumps(network)]})

    # One row for each id before all go to one task.
    once = matched.groupBy("doc_id", "lang").agg(F.max_by("text", F.md5("text")).alias("text")).select("doc_id", "text", "lang")
    trained = once.repartition(1).mapInPandas(run, "network binary").collect()
    return pickle.loads(bytes(trained[0].network)) if trained else None


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            named, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            able = [i for i, letters in enumerate(batch.column(3).to_pylist()) if letters] if model else []
            if able:
                chances = model.predict([text.encode("utf-8", "replace") for text in batch.column(2).take(pa.array(able)).to_pylist()])
                for i, row in zip(able, chances, strict=True):
                    named[i], scores[i] = model.languages[int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(named, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    source = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of("text").alias("text"), text_of("text").rlike(r"\p{L}").alias("letters")
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
