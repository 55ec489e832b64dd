"""Token counts as delta-maintained rollups.

A batch holds changes of documents: a row with a count sets what a document has under a tokenizer version, a row without one
deletes it. Against the ledger of what earlier batches set, each change becomes signed deltas: minus the old count where
it was counted, plus the new one where it belongs now. The deltas of a batch, summed by source, language and version, are
small; totals are the sum over batches, so no batch reads the corpus again.

A batch is written in three steps: its ledger rows, its summed deltas, and last its commit mark. Readers use committed batches only.
Applying a committed batch again changes nothing; a batch that died half-way is overwritten by the next attempt.

Definitions: null sources and languages are groups of their own. Changes with a null id or version are ignored. Of several
changes of one document and version in a batch, the one with the largest count wins, then the largest source and language; a
deletion loses to any count. Deleting what was never counted changes nothing. A text that is null or empty has 0 tokens.
Totals that fall to no document disappear. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship
from weirworks.llm.tokens import TokenEncoder

KEYS = ("source", "lang", "version")
CHANGE = "doc_id long, version string, source string, lang string, n_tokens long"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
#: Pieces of text whose counts a worker remembers.
MEMO = 800_000


class PieceCounts(dict):
    """Tokens of a piece under several tokenizers of one pattern, packed into one integer of 40 bits each."""

    def __init__(self, ranks_paths: list[str], pattern: str):
        super().__init__()
        self.encoders = [TokenEncoder(path, pattern, 4) for path in ranks_paths]

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        packed = sum(len(encoder.library.encode_ordinary(piece)) << (40 * k) for k, encoder in enumerate(self.encoders))
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def __call__(self, text: str | None) -> list[int]:
        packed = sum(map(self.__getitem__, self.encoders[0].split(text))) if text else 0
        return [(packed >> (40 * k)) & ((1 << 40) - 1) for k in range(len(self.encoders))]


@lru_cache(maxsize=2)
def piece_counts(ranks_paths: tuple[str, ...], pattern: str) -> PieceCounts:
    """One counter for each worker process and set of tokenizers."""
    return PieceCounts(list(ranks_paths), pattern)


def token_counts(
    docs: DataFrame, versions: Mapping[str, str], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """Changes that set the counts of every document under each version; ``versions``: name and rank file."""
    ship(docs.sparkSession)
    names, paths = list(versions), list(versions.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        count = piece_counts(tuple(paths), pattern)
        for batch in batches:
            counts = [count(text) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array([c[k] for c in counts], pa.int64()) for k in range(len(names))]],
                names=["doc_id", "source", "lang", *[f"n{k}" for k in range(len(names))]],
            )

    source = pick(docs, doc_id=id_col, source=source_col, lang=lang_col, text=text_col)
    source = source.withColumn("doc_id", F.col("doc_id").cast("long"))
    wide = source.mapInArrow(run, "doc_id long, source string, lang string, " + ", ".join(f"n{k} long" for k in range(len(names))))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("version"), F.col(f"n{k}").alias("n_tokens")) for k, name in enumerate(names)]))
    return wide.select("doc_id", "source", "lang", each.alias("v")).select("doc_id", "v.version", "source", "lang", "v.n_tokens")


@dataclass
class TokenRollup:
    """The ledger, deltas and commit marks in one shared folder."""

    spark: SparkSession
    folder: str

    def _committed(self) -> list[int]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/batch=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(status.getPath().getParent().getName().removeprefix("batch=")) for status in found or [])

    def _read(self, what: str, schema: str, batches: list[int]) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{what}/batch={b}").withColumn("batch", F.lit(b)) for b in batches]
        out = self.spark.createDataFrame([], f"{schema}, batch int")
        for part in parts:
            out = out.unionAll(part)
        return out

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before. Batches are numbered in the order they apply."""
        done = self._committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]} was committed")
        rank = F.struct(F.coalesce("n_tokens", F.lit(-1)), "source", "lang")
        best = changes.where("doc_id IS NOT NULL AND version IS NOT NULL").groupBy("doc_id", "version").agg(
            F.max_by(F.struct("source", "lang", "n_tokens"), rank).alias("new")
        )
        ledger = f"{self.folder}/ledger/batch={batch}"
        best.select("doc_id", "version", "new.*").write.mode("overwrite").parquet(ledger)
        new = self.spark.read.schema(CHANGE).parquet(ledger)
        old = self._read("ledger", CHANGE, done).groupBy("doc_id", "version").agg(
            F.max_by(F.struct("source", "lang", "n_tokens"), "batch").alias("old")
        )
        replaced = old.join(new.select("doc_id", "version"), ["doc_id", "version"], "left_semi").where("old.n_tokens IS NOT NULL")
        minus = replaced.select("old.source", "old.lang", "version", F.lit(-1).cast("long").alias("n_docs"), (-F.col("old.n_tokens")).alias("n_tokens"))
        plus = new.where("n_tokens IS NOT NULL").select("source", "lang", "version", F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        deltas = plus.unionAll(minus).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        deltas.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        deltas = self._read("deltas", DELTA, self._committed())
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")
