"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride binary shards.

1. Every document's ids, each closed by a separator, form one long stream, cut into sequences of ``length`` ids. A task
   knows the places of its own documents; the totals of the tasks, one row each, place the tasks.
2. A keyed Feistel network over the smallest even power of two that holds all sequences permutes their numbers. A result
   beyond the last number is permuted again until it lies within (cycle-walking), so that every sequence gets its own slot
   and every slot a sequence, without sorting or coordination.
3. A shard is a range of ``per_shard`` slots. It is written as one file: record i of shard s, the sequence of slot
   s * per_shard + i, starts at byte i * length * width. A reader can seek to any slot and go on from any record. The file
   ends with one line feed, which belongs to no record. Files come from Spark's writer, which commits a task's files once.

Definitions: a null text is an empty one; an empty document is a separator only. Rows that repeat an id are documents of
their own. The last sequence is filled up with separators. An empty table gives no shard. Extra columns are ignored. The
numbers of the sequences follow the stored ids, so they stay the same for as long as that table does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship
from weirworks.llm.tokens import token_encoder
from weirworks.session import drop_path, scratch_path


@dataclass(frozen=True)
class ShardRules:
    length: int = 1_024
    per_shard: int = 2_048
    key: int = 20_240_229
    rounds: int = 6
    #: Bytes of an id, and the id between documents.
    width: int = 2
    separator: int = 50_256

    @property
    def stride(self) -> int:
        return self.length * self.width


class Permutation:
    """A keyed bijection of 0 .. size - 1."""

    def __init__(self, size: int, key: int, rounds: int = 6):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [self._scramble(np.array([key + r], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] for r in range(rounds)]

    @staticmethod
    def _scramble(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            return x ^ (x >> np.uint64(33))

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in keys:
            left, right = right, left ^ (self._scramble(right ^ key) & self.mask)
        # The halves change places at the end, so that the keys in reverse undo it.
        return (right << shift) | left

    def _walk(self, numbers: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        out = self._once(np.asarray(numbers, dtype=np.uint64), keys)
        while (beyond := out >= np.uint64(self.size)).any():
            out[beyond] = self._once(out[beyond], keys)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


def _stream(docs: DataFrame, ranks_path: str, pattern: str, rules: ShardRules) -> DataFrame:
    """(part, start, ids): each document's ids with the separator, and where they start in its task's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        code, part, start = token_encoder(ranks_path, pattern, rules.width), TaskContext.get().partitionId(), 0
        end = rules.separator.to_bytes(rules.width, "little")
        for batch in batches:
            ids = [code(text) + end for text in batch.column(0).to_pylist()]
            sizes = np.array([len(i) // rules.width for i in ids], dtype=np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part)), pa.array(starts), pa.array(ids, pa.binary())], names=["part", "start", "ids"]
            )

    return docs.mapInArrow(run, "part long, start long, ids binary")


def _pieces(stream: DataFrame, bases: dict[int, int], total: int, rules: ShardRules) -> DataFrame:
    """(shard, slot, at, piece): the stream cut at sequence borders; documents that follow each other are joined first.

    Pieces are compressed one by one, because the shuffle's own fast compression does little for ids.
    """
    spark = stream.sparkSession
    shared = spark.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        order = Permutation(-(-total // rules.length), rules.key, rules.rounds)
        for batch in batches:
            parts, starts, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            numbers, offsets, cut, pack = [], [], [], zstandard.ZstdCompressor(level=3).compress

            def flush(begin: int, held: list[bytes]) -> None:
                joined, at = b"".join(held), 0
                while at < len(joined):
                    place = begin + at // rules.width
                    size = min(len(joined) - at, (rules.length - place % rules.length) * rules.width)
                    numbers.append(place // rules.length)
                    offsets.append(place % rules.length)
                    cut.append(pack(joined[at : at + size]))
                    at += size

            begin, end, held = 0, None, []
            for part, start, own in zip(parts, starts, ids, strict=True):
                place = shared.value[part] + start
                if place != end:
                    flush(begin, held)
                    begin, held = place, []
                held.append(own)
                end = place + len(own) // rules.width
            flush(begin, held)
            slots = order.slots(np.array(numbers, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots // rules.per_shard), pa.array(slots), pa.array(offsets, pa.int32()), pa.array(cut, pa.binary())],
                names=["shard", "slot", "at", "piece"],
            )

    return stream.mapInArrow(run, "shard long, slot long, at int, piece binary")


def _assembled(pieces: DataFrame, slots: int, rules: ShardRules) -> DataFrame:
    """(shard, content): whole shards from pieces that arrive sorted by shard, slot and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        def row(shard: int, held: list[bytes]) -> pa.RecordBatch:
            content = b"".join(held)
            missing = min(rules.per_shard, slots - shard * rules.per_shard) * rules.stride - len(content)
            if missing:  # a gap at the end of the last sequence was filled in place; anything else is a lost piece
                raise ValueError(f"shard {shard} lacks {missing} bytes")
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([content], pa.binary())], names=["shard", "content"])

        current, held, unpack = None, [], zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for shard, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if shard != current:
                    if held:
                        yield row(current, held)
                    current, held = shard, []
                held.append(unpack(piece))
        if held:
            yield row(current, held)

    return pieces.mapInArrow(run, "shard long, content binary")


def write_shards(
    docs: DataFrame, path: str, ranks_path: str, pattern: str, rules: ShardRules = ShardRules(), text_col: str = "text"
) -> int:
    """Write the shards below ``path`` as ``shard=<number>/part-...`` and return the number of sequences."""
    spark = docs.sparkSession
    ship(spark)
    stored = scratch_path(spark, "token-stream")
    stream = _stream(pick(docs, text=text_col), ranks_path, pattern, rules)
    pages = {"parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(4 << 20)}
    stream.write.option("compression", "zstd").options(**pages).parquet(stored)
    stream = spark.read.schema(stream.schema).parquet(stored)
    # One row for each task that wrote the stream.
    totals = stream.groupBy("part").agg(F.max(F.col("start") + F.expr(f"octet_length(ids) div {rules.width}")).alias("n")).orderBy("part").collect()
    bases, total = {}, 0
    for part, n in totals:
        bases[part], total = total, total + n
    sequences = -(-total // rules.length)
    if sequences:
        gap = sequences * rules.length - total
        pieces = _pieces(stream, bases, total, rules)
        if gap:
            last = int(Permutation(sequences, rules.key, rules.rounds).slots(np.array([sequences - 1]))[0])
            filling = bytearray(zstandard.compress(rules.separator.to_bytes(rules.width, "little") * gap))
            pieces = pieces.unionAll(spark.createDataFrame([(last // rules.per_shard, last, rules.length - gap, filling)], pieces.schema))
        shards = -(-sequences // rules.per_shard)
        tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        ordered = pieces.repartition(tasks, "shard").sortWithinPartitions("shard", "slot", "at")
        whole = _assembled(ordered, sequences, rules)
        whole.select(F.col("content").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\n").text(path)
    drop_path(spark, stored)
    return sequences


def read_shards(spark: SparkSession, path: str, sequences: int, rules: ShardRules = ShardRules()) -> DataFrame:
    """(slot, shard, byte_offset, ids): every record of the shards; a file of the wrong size ends the job."""
    files = spark.read.format("binaryFile").load(f"{path}/shard=*") if sequences else None
    if files is None:
        return spark.createDataFrame([], "slot long, shard long, byte_offset long, ids binary")
    shard = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long")
    records = F.least(F.lit(rules.per_shard), F.lit(sequences) - shard * rules.per_shard).cast("int")
    sound = F.col("length") == records * rules.stride + 1
    checked = F.when(sound, F.col("content")).otherwise(F.raise_error(F.lit("a shard has the wrong size")).cast("binary"))
    rows = files.select(shard.alias("shard"), checked.alias("content"), F.explode(F.sequence(F.lit(0), records - 1)).alias("i"))
    return rows.select(
        (F.col("shard") * rules.per_shard + F.col("i")).alias("slot"), "shard", (F.col("i") * F.lit(rules.stride)).cast("long").alias("byte_offset"),
        F.expr(f"substring(content, i * {rules.stride} + 1, {rules.stride})").alias("ids"),
    )


def with_numbers(records: DataFrame, sequences: int, rules: ShardRules = ShardRules()) -> DataFrame:
    """(slot, shard, byte_offset, sequence, ids_sha256): each record's number in the stream, and a digest of its ids."""
    digests = records.select("slot", "shard", "byte_offset", F.sha2("ids", 256).alias("ids_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        order = Permutation(max(1, sequences), rules.key, rules.rounds)
        for batch in batches:
            numbers = order.numbers(batch.column(0).to_numpy()) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "sequence"])

    return digests.mapInArrow(run, "slot long, shard long, byte_offset long, ids_sha256 string, sequence long")
