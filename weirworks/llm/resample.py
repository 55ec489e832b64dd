"""Importance resampling towards a target distribution, with the cutoff found by weighted medians of medians.

Features are hashed runs of one to three words. How often each bucket occurs in all documents and in all target texts gives
one gain for each bucket; the array of gains scores a document by the sum over its features. A keyed Gumbel draw for each id
is added, so the highest scores are a sample without replacement in proportion to the weights.

The cutoff is an exact order statistic over all eligible rows: every partition names the median of its remaining keys, the
median of those medians, weighted by how many keys each partition still has, becomes the pivot, and the side that cannot hold
the cutoff goes. At least a quarter of the keys goes in each round, rounds rewrite what is left once it has shrunk fourfold, and
only the rows at or above the cutoff are sorted and numbered.

Definitions: only A-Z are lower-cased; words are ``WORD``, a null or empty text has none, a document without words has weight
0. Features repeat as often as they occur. Eligible are documents with at least ``min_words`` words; ``percent`` per cent of
them, rounded down, are drawn: highest score first, then smallest id, null ids last; rows that repeat an id are rows of their
own and get ranks of their own. Undrawn rows have a null rank, also where nothing is eligible. An empty target gives the gains
of its smoothing alone. Ids are integers. Extra columns are ignored.

The gains are the only data that all tasks get: one number for each bucket, whatever the input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship
from weirworks.session import drop_path, scratch_path

#: What a word is, after A-Z were lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ENDS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TIDY = bytes(32 if c in _ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONES = 0xFFFFFFFF
#: Words that a worker remembers, and words whose runs are hashed at a time.
MEMO, SLICE = 400_000, 1 << 19
#: Order of ids that are null.
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class ResampleRules:
    buckets: int = 10_000
    longest: int = 3
    min_words: int = 20
    percent: int = 5
    seed: int = 42


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TIDY).split()


def _advance(n: int) -> np.ndarray:
    """What ``n`` more bytes do to a checksum state, by byte of the state: four tables of 256 entries."""
    tables = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        moved, (byte, place) = zlib.crc32(bytes(n), (1 << bit) ^ _ONES) ^ _ONES, divmod(bit, 8)
        tables[byte, (np.arange(256) >> place) & 1 == 1] ^= np.uint32(moved)
    return tables


class RunHasher:
    """Buckets of the word runs of many texts at once.

    The checksum of a run follows from those of its words: the state after one word, moved on by the length of the next, and
    the next word's own part. So every different word is hashed once and runs take table look-ups only.
    """

    def __init__(self, rules: ResampleRules):
        self.rules = rules
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.lengths: dict[int, int] = {}
        self.tables = np.zeros((0, 4, 256), dtype=np.uint32)
        self.first, self.next, self.step = (np.zeros(1 << 12, dtype=kind) for kind in (np.uint32, np.uint32, np.int64))

    def _place(self, word: bytes) -> int:
        place = self.places[word] = len(self.places)
        if place == len(self.first):
            self.first, self.next, self.step = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.next, self.step))
        tail = b" " + word
        if len(tail) not in self.lengths:
            self.lengths[len(tail)] = len(self.tables)
            self.tables = np.concatenate([self.tables, _advance(len(tail))[None]])
        self.first[place], self.next[place] = zlib.crc32(word) ^ _ONES, zlib.crc32(tail, _ONES) ^ _ONES
        self.step[place] = self.lengths[len(tail)]
        return place

    def places_of(self, words: list[bytes]) -> np.ndarray:
        known, add = self.places, self._place
        return np.fromiter((known[w] if w in known else add(w) for w in words), dtype=np.int64, count=len(words))

    def runs(self, texts: list[str | None]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """(words of each text, pieces of (text number, bucket) of every run)."""
        if len(self.places) > MEMO:
            self.clear()
        found = [self.places_of(words_of(text)) for text in texts]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        return sizes, self._pieces(flat, np.repeat(np.arange(len(found)), sizes))

    def _pieces(self, flat: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(flat), SLICE):
            end = min(start + SLICE, len(flat))
            state, whose = self.first[flat[start:end]], owner[start:end]
            yield whose, (state ^ np.uint32(_ONES)) % self.rules.buckets
            for more in range(1, self.rules.longest):
                upto = min(end, len(flat) - more)
                if upto <= start:
                    break
                word, state, whose = flat[start + more : upto + more], state[: upto - start], whose[: upto - start]
                tables = self.tables[:, 0], self.tables[:, 1], self.tables[:, 2], self.tables[:, 3]
                step, moved = self.step[word], self.next[word]
                for k, rows in enumerate(tables):
                    moved = moved ^ rows[step, (state >> np.uint32(8 * k)) & np.uint32(255)]
                state = moved
                within = whose == owner[start + more : upto + more]
                yield whose[within], (state[within] ^ np.uint32(_ONES)) % self.rules.buckets


def bucket_counts(texts: DataFrame, rules: ResampleRules) -> tuple[np.ndarray, int]:
    """(occurrences of each bucket, texts with enough words) over all rows of the one column ``text``.

    Every task sums its rows first and sends a row for each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher, counts, enough = RunHasher(rules), np.zeros(rules.buckets, dtype=np.int64), 0
        for batch in batches:
            sizes, pieces = hasher.runs(batch.column(0).to_pylist())
            enough += int((sizes >= rules.min_words).sum())
            for _, buckets in pieces:
                counts += np.bincount(buckets, minlength=rules.buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*met, -1], pa.int32()), pa.array([*counts[met], enough], pa.int64())], names=["bucket", "n"])

    totals = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts, enough = np.zeros(rules.buckets, dtype=np.int64), 0
    for row in totals:
        if row.bucket < 0:
            enough = row.n
        else:
            counts[row.bucket] = row.n
    return counts, enough


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths of a nat, rounded down."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = (float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def _draw(rules: ResampleRules) -> Column:
    """The Gumbel draw of an id, in thousandths, rounded down."""
    text = F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, table: np.ndarray, rules: ResampleRules) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher = RunHasher(rules)
        for batch in batches:
            sizes, pieces = hasher.runs(batch.column(1).to_pylist())
            weight, features = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
            for whose, buckets in pieces:
                features += np.bincount(whose, minlength=len(sizes))
                ends = np.flatnonzero(np.diff(whose, append=-1))
                sums = np.diff(np.cumsum(table[buckets])[ends], prepend=0)
                weight[whose[ends]] += sums
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (sizes, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + _draw(rules))


@dataclass(frozen=True)
class Key:
    """A place in the order: higher scores first, then smaller ids."""

    score: int
    id: int

    @property
    def order(self) -> tuple[int, int]:
        return -self.score, self.id


def _median(score: np.ndarray, ids: np.ndarray) -> tuple[int, int] | None:
    """The lower median in that order."""
    if not len(score):
        return None
    place = (len(score) - 1) // 2
    at = -int(np.partition(-score, place)[place])
    ties = ids[score == at]
    skip = place - int((score > at).sum())
    return at, int(np.partition(ties, skip)[skip])


def _round(keys: DataFrame, pivot: Key | None) -> list:
    """For every partition: how many keys come before, at and after the pivot, and the medians before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        if pivot is None:
            before, at = np.zeros(len(score), dtype=bool), np.zeros(len(score), dtype=bool)
        else:
            tied = score == pivot.score
            before, at = (score > pivot.score) | (tied & (ids < pivot.id)), tied & (ids == pivot.id)
        after = ~(before | at)
        low, high = _median(score[before], ids[before]) or (None, None), _median(score[after], ids[after]) or (None, None)
        row = [int(before.sum()), int(at.sum()), int(after.sum()), *low, *high]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=_ROUND)

    return keys.mapInArrow(run, ", ".join(f"{c} long" for c in _ROUND)).collect()


_ROUND = ["before", "same", "after", "low_score", "low_id", "high_score", "high_id"]


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first median with half of all keys in partitions whose medians come no later."""
    seen, half = 0, sum(n for _, n in medians) / 2
    for key, n in sorted(medians, key=lambda m: m[0].order):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys left")


def cutoff(keys: DataFrame, wanted: int) -> Key | None:
    """The key of rank ``wanted`` among the rows (score, id); None if there is none."""
    if wanted < 1:
        return None
    spark, scratch = keys.sparkSession, None
    left, stored, pivot = None, None, None
    while True:
        parts = _round(keys, pivot)
        before, same = sum(p.before for p in parts), sum(p.same for p in parts)
        if before < wanted <= before + same:
            if scratch:
                drop_path(spark, scratch)
            return pivot
        first = wanted <= before
        left = before if first else sum(p.after for p in parts)
        if not left:
            return None
        stored = stored or left
        if pivot is not None:
            tied = F.col("score") == pivot.score
            keys = keys.where((F.col("score") > pivot.score) | (tied & (F.col("id") < pivot.id))) if first else keys.where((F.col("score") < pivot.score) | (tied & (F.col("id") > pivot.id)))
            wanted -= 0 if first else before + same
        if left * 4 <= stored:
            path = scratch_path(spark, "keys")
            keys.write.parquet(path)
            keys, stored = spark.read.schema(keys.schema).parquet(path), left
            if scratch:
                drop_path(spark, scratch)
            scratch = path
        medians = [(Key(p.low_score, p.low_id), p.before) if first else (Key(p.high_score, p.high_id), p.after) for p in parts if (p.before if first else p.after)]
        pivot = _weighted_median(medians)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``rank`` (from 1) in the order given: a range sort, and the sizes of its partitions added up."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "ranked")
    rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_part", F.shiftright("_place", 33))
    sizes = sorted((r["_part"], r["count"]) for r in stored.groupBy("_part").count().collect())
    ends = np.cumsum([n for _, n in sizes]).tolist()
    starts = spark.createDataFrame([(p, end - n) for (p, n), end in zip(sizes, ends, strict=True)], "_part long, _start long")
    joined = stored.join(F.broadcast(starts), "_part")  # one row for each partition
    return joined.withColumn("rank", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_place", "_part", "_start")


def resample(
    docs: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null where it was not drawn."""
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    source, enough = bucket_counts(rows.select("text"), rules)
    table = gains(source, bucket_counts(pick(target, text=target_text), rules)[0])
    path = scratch_path(spark, "weights")
    scored(rows, table, rules).write.parquet(path)
    stored = spark.read.parquet(path)
    wanted = rules.percent * enough // 100
    result = ["doc_id", "n_features", "weight", "score"]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    last = cutoff(stored.where(F.col("n_words") >= rules.min_words).select("score", key.alias("id")), wanted)
    if last is None:
        return stored.select(*result, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= rules.min_words) & ((F.col("score") > last.score) | ((F.col("score") == last.score) & (key <= last.id)))
    winners = numbered(stored.where(drawn).select(*result), F.desc("score"), key.asc())
    # Rows that repeat the key at the cutoff may be one too many.
    winners = winners.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return winners.select(*result, "rank").unionAll(stored.where(~drawn).select(*result, F.lit(None).cast("long").alias("rank")))
