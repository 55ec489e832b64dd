"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by k = floor(rate * n) edits. Cut into k + 1 pieces, at least one piece
of it then stands in the passage unchanged. One automaton finds the exact hits of all pieces in a text; each hit fixes where
the item would lie, give or take k; and Myers' bit-parallel algorithm gives the smallest edit distance of the item to any
substring there. No passage within the budget is missed, and every reported distance is exact.

Texts are compared lower-cased, with each run of white space as one space. The items go to the tasks in blocks of bounded
size; the documents are read once for each block and are never shuffled.

Definitions: items below ``min_chars`` normalised characters, empty and null ones take no part, because they say too little
to tell a leak. Items with equal normal forms count as one, under the smallest id; items with a null id take no part. A null
document is empty. A document with a null id is reported with a null id. Rows that repeat a document id are reported once
with the smallest distance. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship
from weirworks.session import materialised

_ONE = np.uint64(1)
_TOP = np.uint64(63)


@dataclass(frozen=True)
class LeakRules:
    #: Edits allowed for each character of an item.
    rate: float = 0.08
    min_chars: int = 20
    #: Normalised characters of the items that a task holds at once.
    block_chars: int = 1_000_000
    #: Windows verified together.
    windows: int = 2_048


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Matcher:
    """The pieces of a block of items in one automaton, and the bit vectors to verify them."""

    def __init__(self, items: list[str], rules: LeakRules):
        self.items, self.rules = items, rules
        self.budget = [int(len(item) * rules.rate) for item in items]
        self.words = np.array([-(-len(item) // 64) for item in items])
        self.alphabet = np.unique(np.concatenate([self._codes(item) for item in items]))
        # bits[item, character, word]: the positions of a character in an item; the last character stands for all others.
        self.bits = np.zeros((len(items), len(self.alphabet) + 1, int(self.words.max())), dtype=np.uint64)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            at = np.searchsorted(self.alphabet, self._codes(item))
            position = np.arange(len(item))
            np.bitwise_or.at(self.bits, (i, at, position // 64), _ONE << (position % 64).astype(np.uint64))
            parts = self.budget[i] + 1
            cuts = [len(item) * j // parts for j in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(item[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def windows(self, text: str) -> list[tuple[int, int, int]]:
        """(item, start, end) of the stretches where an item can lie; hits on nearby diagonals share one."""
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, offset in places:
                starts.setdefault(item, set()).add(end + 1 - size - offset)
        found = []
        for item, diagonals in starts.items():
            budget, length, ordered, at = self.budget[item], len(self.items[item]), sorted(diagonals), 0
            while at < len(ordered):
                low = ordered[at]
                at = bisect_right(ordered, low + 2 * budget, at)
                found.append((item, max(0, low - budget), min(len(text), ordered[at - 1] + length + budget)))
        return found

    def distances(self, texts: list[str], windows: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
        """For (text, item, start, end): the smallest distance of the item to a substring, and where the first such ends."""
        out: list[tuple[int, int]] = [(0, 0)] * len(windows)
        order = sorted(range(len(windows)), key=lambda w: (self.words[windows[w][1]], windows[w][3] - windows[w][2]))
        for first in range(0, len(order), self.rules.windows):
            some = order[first : first + self.rules.windows]
            words = int(self.words[windows[some[-1]][1]])
            best, at = self._myers(texts, [windows[w] for w in some], words)
            for w, distance, end in zip(some, best.tolist(), at.tolist(), strict=True):
                out[w] = (distance, windows[w][2] + end)
        return out

    def _myers(self, texts: list[str], windows: list[tuple[int, int, int, int]], words: int) -> tuple[np.ndarray, np.ndarray]:
        count, longest = len(windows), max(end - start for _, _, start, end in windows)
        codes = np.full((longest, count), len(self.alphabet), dtype=np.int64)
        for w, (text, _, start, end) in enumerate(windows):
            own = self._codes(texts[text][start:end])
            at = np.minimum(np.searchsorted(self.alphabet, own), len(self.alphabet) - 1)
            codes[: len(own), w] = np.where(self.alphabet[at] == own, at, len(self.alphabet))
        item = np.array([w[1] for w in windows])
        length = np.array([len(self.items[i]) for i in item])
        last_word, last_bit = (length - 1) // 64, ((length - 1) % 64).astype(np.uint64)
        ups = [np.full(count, ~np.uint64(0)) for _ in range(words)]
        downs = [np.zeros(count, dtype=np.uint64) for _ in range(words)]
        score, best, best_at = length.copy(), length.copy(), np.zeros(count, dtype=np.int64)
        ends = [last_word == word for word in range(words)]
        for t in range(longest):
            seen = self.bits[item, codes[t]]
            plus, minus = np.zeros(count, dtype=np.uint64), np.zeros(count, dtype=np.uint64)
            for word in range(words):
                up, down, same = ups[word], downs[word], seen[:, word]
                vertical = same | down
                same = same | minus
                across = (((same & up) + up) ^ up) | same
                rise, fall = down | ~(across | up), up & across
                if ends[word].any():
                    score += np.where(ends[word], ((rise >> last_bit) & _ONE).astype(np.int64) - ((fall >> last_bit) & _ONE).astype(np.int64), 0)
                out_plus, out_minus = rise >> _TOP, fall >> _TOP
                rise, fall = (rise << _ONE) | plus, (fall << _ONE) | minus
                ups[word], downs[word] = fall | ~(vertical | rise), rise & vertical
                plus, minus = out_plus, out_minus
            better = score < best
            best[better], best_at[better] = score[better], t + 1
        return best, best_at


def leaks(
    docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(), id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, distance, max_distance, ends_at): every item that a document contains within its budget.

    ``ends_at`` is the end of the first best passage in the normalised text.
    """
    spark = docs.sparkSession
    ship(spark)
    squeezed = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", " "))
    size = F.length(squeezed)
    listed = materialised(pick(items, item_id=item_col, text=item_text_col).where(F.col("item_id").isNotNull() & (size > 0)), "items")
    blocks = max(1, -(-(listed.agg(F.sum(F.length("text"))).first()[0] or 0) // rules.block_chars))
    listed = listed.withColumn("block", F.pmod(F.xxhash64(squeezed), F.lit(blocks)))
    source = pick(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, max_distance int, ends_at int"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        owner: dict[str, int] = {}
        for item_id, text in listed.where(F.col("block") == block).select("item_id", "text").toLocalIterator():
            text = normal(text)
            if len(text) >= rules.min_chars:
                owner[text] = min(item_id, owner.get(text, item_id))
        if owner:
            shared = spark.sparkContext.broadcast(([*owner], [*owner.values()]))
            found = found.unionAll(source.mapInArrow(_scan(shared, rules), schema))
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "max_distance", "ends_at")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def _scan(shared, rules: LeakRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        texts, ids = shared.value
        matcher = Matcher(texts, rules)
        for batch in batches:
            docs = [normal(text) for text in batch.column(1).to_pylist()]
            windows = [(d, *window) for d, doc in enumerate(docs) for window in matcher.windows(doc)]
            rows = [
                (w[0], ids[w[1]], distance, matcher.budget[w[1]], end)
                for w, (distance, end) in zip(windows, matcher.distances(docs, windows), strict=True)
                if distance <= matcher.budget[w[1]]
            ]
            at = pa.array([row[0] for row in rows], pa.int32())
            numbers = [pa.array([row[k] for row in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *numbers], names=["doc_id", "item_id", "distance", "max_distance", "ends_at"])

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, without the documents that contain an item. Rows without an id stay."""
    leaking = leaks(docs, items, rules, id_col, text_col).select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(leaking, docs[id_col] == leaking["_leaking"], "left_anti")
